"""Column-level scalar functions (mail, HTML text, text cleaning, prompts, answers)."""

from litsift.functions import mail, prompt, response, text  # noqa: F401
