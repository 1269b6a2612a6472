"""Where files are: data and model roots, and the places of generated, scored and evaluated files."""

from __future__ import annotations

import os

#: Fixed formats: candidates for generated answers, in order; scores; reports.  ``{d}`` data set, ``{m}`` model, ``{u}`` method.
GENERATED = ["output/{d}/{m}/{d}_{m}.json", "output/{d}/{d}_{m}.json", "output/{d}_{m}.json"]
SCORES = "uq_output/{d}/{m}/{d}_{m}_{u}.json"
QA_REPORT = "eval_results/{d}_{m}_accuracy.json"
UQ_REPORT = "eval_results/{d}_{m}_{u}_eval.json"
ALIASES = {"trivia": "triviaqa", "triviaqa": "trivia"}


def root(given: str | None, variable: str, default: str) -> str:
    """An argument goes before the environment variable, which goes before the default."""
    return given or os.environ.get(variable) or default


def generated(dataset: str, model: str, given: str | None = None, base: str = "") -> str:
    """The given path, else the first candidate that exists, also under the data set's other name, else the first."""
    names = [dataset, *([ALIASES[dataset]] if dataset in ALIASES else [])]
    candidates = [os.path.join(base, form.format(d=d, m=model)) for d in names for form in GENERATED]
    return given or next((c for c in candidates if os.path.exists(c)), candidates[0])


def scores(dataset: str, model: str, method: str, given: str | None = None, base: str = "") -> str:
    return given or os.path.join(base, SCORES.format(d=dataset, m=model, u=method))


def qa_report(dataset: str, model: str, given: str | None = None, base: str = "") -> str:
    return given or os.path.join(base, QA_REPORT.format(d=dataset, m=model))


def uq_report(dataset: str, model: str, method: str, given: str | None = None, base: str = "") -> str:
    return given or os.path.join(base, UQ_REPORT.format(d=dataset, m=model, u=method))
