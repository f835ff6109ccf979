"""Prompt text as columns, one prompt per row, ready for batch inference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt texts.
SUMMARIZE = "Summarize the following section:"
JUDGE = "Is the following text inappropriate for work? Answer yes or no."
INCIDENT = "User asked about an incident: {incident_id}. Look it up and summarize."
ASSISTANT = (
    "You are a helpful AI assistant using knowledge from internal wiki documents, trouble "
    "shooting guides and incident reports. Answer queries clearly and concisely. Use the "
    "tools if needed."
)
KEYWORDS = (
    "Extract up to {n} concise, relevant keywords or key phrases from the following text:\n\n{text}\n\n"
    "Return them as a comma-separated list."
)
EVALUATE = (
    "\nYou are an expert evaluator. Given the following document chunk summary, rate its quality "
    "on a scale from 1 to 10 and provide a short justification.\n\nSummary:\n{summary}"
    '\n\nPlease respond in JSON format with:\n{\n  "score": int,\n  "reason": str\n}\n'
)


def filled(template: str, name: str, value: Column) -> Column:
    """A template with the placeholder {name} replaced by a column, whatever that holds."""
    before, after = template.split("{" + name + "}")
    return F.concat(F.lit(before), value, F.lit(after))


def summarize(chunk: Column) -> Column:
    return F.concat(F.lit(SUMMARIZE + "\n\n"), chunk)


def judge(text: Column) -> Column:
    return F.concat(F.lit(JUDGE + "\n\n"), text)


def keywords(text: Column, limit: int = 10) -> Column:
    return filled(KEYWORDS.replace("{n}", str(limit)), "text", text)


def evaluate(summary: Column) -> Column:
    return filled(EVALUATE, "summary", summary)


def incident(incident_id: Column) -> Column:
    return filled(INCIDENT, "incident_id", incident_id.cast("string"))


def answer(question: Column, context: Column) -> Column:
    """Question with the retrieved context put before it."""
    return F.concat(F.lit(ASSISTANT + "\n\n"), context, F.lit("\n\nQuestion: "), question)
