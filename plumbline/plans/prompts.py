"""Chat prompts of the data sets: an array of (role, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import truncate_chars

#: The system message of each data set, and how question and context become the user message.
SHORT = "Output a short answer with minimum words"
SYSTEM = {
    "triviaqa": SHORT,
    "nq": SHORT,
    "coqa": SHORT,
    "squad": SHORT,
    "bioasq": SHORT,
    "svamp": "Only output a number answer",
    "gsm8k": "Solve this math problem step by step and provide the final numerical answer after ####.",
    "xsum": "Summarize the given article in one short sentence.",
    "aeslc": "Generate a concise email subject line.",
    "cnn_dailymail": "Summarize the given news article in 2-3 concise sentences.",
    "multi_news": "Summarize the following multi-document news in 2-3 concise sentences.",
    "wmt19": "Translate from {source} to {target}. Output only the translated text.",
}
USER = {"coqa": ("story: ", "\n question: "), "squad": ("Context: ", "\nQuestion: ")}

#: Fixed value: how a model is asked whether one answer entails another.
ENTAILMENT = (
    'We are evaluating answers to the question "{question}"\nHere are two possible answers:\nPossible Answer 1: {text1}\nPossible Answer 2: {text2}\n'
    "Does Possible Answer 1 semantically entail Possible Answer 2? Respond with ONLY entailment, contradiction, or neutral."
)


def entailment_messages(question: Column, text1: Column, text2: Column) -> Column:
    """One user message; its reply is read by ``functions.text.entailment_label``."""
    parts: list[Column] = []
    rest = ENTAILMENT
    for name, value in (("{question}", question), ("{text1}", text1), ("{text2}", text2)):
        before, _, rest = rest.partition(name)
        parts += [F.lit(before), F.coalesce(value, F.lit(""))]
    out = F.concat(*parts, F.lit(rest))
    return F.array(F.struct(F.lit("user").alias("role"), out.alias("content")))


def prompt(dataset: str, question: Column, context: Column | None = None, max_input_tokens: int = 131_000, subset: str = "cs-en") -> Column:
    system = SYSTEM[dataset].format(source=subset.split("-")[0], target=subset.split("-")[-1])
    user = question
    if dataset in USER:
        before, between = USER[dataset]
        user = F.concat(F.lit(before), F.coalesce(context, F.lit("")), F.lit(between), question)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", truncate_chars(user, max_input_tokens)))


def prompts(gold: DataFrame, dataset: str, max_input_tokens: int = 131_000, subset: str = "cs-en") -> DataFrame:
    context = F.col("context") if "context" in gold.columns else F.lit("")
    return gold.select("qid", "question", prompt(dataset, F.col("question"), context, max_input_tokens, subset).alias("messages"))
