"""Supported scoring models and their prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsift.schemas import MODELS

# ---------------------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results)
# key, name, provider, api model id, description, context window,
# (input USD / 1M tokens, output USD / 1M tokens, currency), default max tokens
# ---------------------------------------------------------------------------------------
MODEL_ROWS = [
    ("gpt-4o", "GPT-4o", "openai", "gpt-4o",
     "OpenAI's most capable model, optimized for chat", 128000, (2.50, 10.00, "USD"), 1024),
    ("gpt-4o-mini", "GPT-4o Mini", "openai", "gpt-4o-mini",
     "Smaller, faster, and more affordable version of GPT-4o", 128000, (0.15, 0.60, "USD"), 1024),
    ("claude-3-7-sonnet", "Claude 3.7 Sonnet", "anthropic", "claude-3-7-sonnet-20240229",
     "Anthropic's advanced model with strong reasoning capabilities", 200000, (3.00, 15.00, "USD"), 4096),
    ("claude-3-5-haiku", "Claude 3.5 Haiku", "anthropic", "claude-3-5-haiku-20240307",
     "Anthropic's smaller, faster model with excellent capabilities", 200000, (0.80, 4.00, "USD"), 4096),
]
DEFAULT_MODEL = "gpt-4o-mini"
# Output-token cap sent with every scoring call.
CALL_MAX_TOKENS = 1000
# ---------------------------------------------------------------------------------------

MODEL_KEYS = [r[0] for r in MODEL_ROWS]


def models_df(spark: SparkSession, model_key: str | None = None) -> DataFrame:
    """All models, or the one row of ``model_key`` (unknown key -> ValueError).

    ``provider_display`` is the provider name capitalised as shown in listings.
    """
    if model_key is not None and model_key not in MODEL_KEYS:
        raise ValueError(f"Model '{model_key}' not found.")
    df = spark.createDataFrame(MODEL_ROWS, MODELS)
    df = df.withColumn("provider_display", F.initcap("provider"))
    return df if model_key is None else df.where(F.col("model_key") == model_key)


def model_info(model_key: str) -> dict:
    """Driver-side lookup for plan-time checks (a 4-row constant, not data)."""
    for r in MODEL_ROWS:
        if r[0] == model_key:
            return {"model_key": r[0], "provider": r[2], "api_model_id": r[3],
                    "input": r[6][0], "output": r[6][1]}
    raise ValueError(f"Model '{model_key}' not supported")
