"""Whole jobs: scoring answer sets, evaluating them, prompts and providers for what models must supply."""
