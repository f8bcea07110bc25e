"""Logs as texts to read: a question with its answer and what was retrieved, and a conversation.

Defined results: what an entry lacks is left empty, an answer it lacks is said to be empty; a source without a name goes by
its id, without either by "?"; hits beyond the tenth aren't shown, of a hit's text a hundred characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import col, strip

#: Kinds of logs, with what their files are named by.
KINDS = {"chat": "chat", "test": "test_chat"}
#: Headings and marks of the texts.
LOG_TITLE, CHAT_TITLE, EMPTY_ANSWER, UNKNOWN = "Juridisk forespørgselslog", "Chat-log", "(Tomt svar)", "?"
ASKED, SAID, CITED, FOUND, TALK = ("─── Spørgsmål ───", "─── Svar ───", "─── Kilder (citations) ───", "─── Retrieval-træf ───", "─── Samtale ───")
SPEAKERS = {"user": "Du:", "assistant": "Assistent:"}
OTHER_SPEAKER = "System:"
HITS, HIT_CHARS = 10, 100


def log_kind(kind: str | Column) -> Column:
    """What a log's file is named by; kinds that aren't known are chats, so a name can't leave the two."""
    low = F.lower(strip(F.coalesce(col(kind), F.lit(""))))
    out = F.lit(KINDS["chat"])
    for name, suffix in KINDS.items():
        out = F.when(low == name, suffix).otherwise(out)
    return out


def _numbered(items: Column, line) -> Column:
    rows = F.transform(F.coalesce(items, F.array()), lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), line(x)))
    return F.coalesce(rows, F.array().cast("array<string>"))


def log_text(created: str, model: str, stores: str, question: str, answer: str, citations: str, results: str) -> Column:
    """An entry as text. ``citations``: array of struct(file_id, filename); ``results``: array of struct(filename, text, ...)."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cited = _numbered(F.col(citations), lambda c: F.coalesce(c["filename"], c["file_id"], F.lit(UNKNOWN)))
    shown = lambda r: F.replace(F.left(F.coalesce(r["text"], F.lit("")), F.lit(HIT_CHARS)), F.lit("\n"), F.lit(" "))
    found = _numbered(F.slice(F.col(results), 1, HITS), lambda r: F.concat(F.coalesce(r["filename"], F.lit(UNKNOWN)), F.lit(": "), shown(r), F.lit("…")))
    head = F.array(
        F.lit(LOG_TITLE), F.concat(F.lit("Tidspunkt: "), said(created)), F.concat(F.lit("Model brugt: "), said(model)),
        F.concat(F.lit("Vector stores: "), F.coalesce(F.array_join(stores, ", "), F.lit(""))), F.lit(""),
        F.lit(ASKED), said(question), F.lit(""), F.lit(SAID), F.coalesce(F.col(answer), F.lit(EMPTY_ANSWER)), F.lit(""), F.lit(CITED),
    )
    return F.array_join(F.concat(head, cited, F.array(F.lit(""), F.lit(FOUND)), found), "\n")


def chat_text(created: Column, updated: Column, model: Column, messages: Column) -> Column:
    """A conversation as text. ``messages``: array of struct(role, text), in order."""
    said = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    speaker = lambda r: F.coalesce(*[F.when(F.lower(r) == k, F.lit(v)) for k, v in SPEAKERS.items()], F.lit(OTHER_SPEAKER))
    told = F.flatten(F.transform(messages, lambda m: F.array(speaker(m["role"]), said(m["text"]), F.lit(""))))
    head = F.array(F.lit(CHAT_TITLE), F.concat(F.lit("Oprettet: "), said(created)), F.concat(F.lit("Opdateret: "), said(F.coalesce(updated, created))), F.concat(F.lit("Model brugt: "), said(model)), F.lit(""), F.lit(TALK))
    return F.array_join(F.concat(head, F.coalesce(told, F.array().cast("array<string>"))), "\n")


def chat_texts(messages: DataFrame, key: str, order: str, role: str, text: str, model: str = "") -> DataFrame:
    """key, log: each conversation as text. A conversation is what one reader reads, so it is put together in one row."""
    row = F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(text).alias("text"))
    said = messages.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("_m"), F.min(order).alias("_a"), F.max(order).alias("_b"))
    return said.select(key, chat_text(F.col("_a"), F.col("_b"), F.lit(model), F.col("_m")).alias("log"))
