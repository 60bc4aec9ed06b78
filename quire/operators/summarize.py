"""Map-reduce summaries with a pluggable model, and their scores.

A chapter's chunks are summarised, reduced, and folded into the story so far, in order; books are independent, so the
fold runs per book. The model is any function from a list of prompts to a list of texts. The default takes leading sentences, so
results can be tested without one.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import chapters_of

Model = Callable[[list[str]], list[str]]
CHUNK_WORDS, OVERLAP_WORDS, WINDOW_WORDS = 4096, 400, 8192
LEAST_CHUNK_WORDS = 20
SEMANTIC, LEXICAL, CONTRADICTION = 0.60, 0.35, 0.50
# What model output is tidied by, in order. Names of commands that lost their backslash, then brackets, marks and formulas.
TIDY = (
    (r"@xmath\d+", ""),
    (r"\blabeleq\d*\b", ""),
    (r"&=&", " = "),
    (r"\s*&\s*([=+\-*/])\s*&\s*", " $1 "),
    (r"\s*&{2,}\s*", " "),
    (r"\\\s*\[", r"\\["),
    (r"\\\s*\]", r"\\]"),
    (r"frac12", r"\\frac{1}{2}"),
    (r"\bleft([(\[{])", r"\\left$1"),
    (r"\bright([)\]}])", r"\\right$1"),
    (r"nonumber", ""),
    (r"endaligned", ""),
    (r"nabla", r"\\nabla"),
    (r"delta_ij", r"\\delta_{ij}"),
    (r"(?<!\\)delta\(", r"\\delta("),
    (r"mathbf([xyn])", r"\\mathbf{$1}"),
    (r"hatbf\s*([a-zA-Z])", r"\\hat{\\mathbf{$1}}"),
    (r"int_v", r"\\int_V"),
    (r"intlimits_0p", r"\\int_{0}^{p}"),
    (r"\.:", ". "),
    (r"\[\s*(?:\[\s*)+", "[ "),
    (r"\]\s*(?:\]\s*)+", "] "),
    (r"([!?])\1{2,}", "$1"),
    (r"(?<lead>\s?)\s*(?<span>[=+\-*/^_()\[\]{},\s']*\\(?:frac|int|delta|nabla|mathbf|hat|left|right)[^.!?;:]*?)\s*(?=[.!?;:]|$)", r"${lead}\\(${span}\\)"),
    (r"\s+", " "),
    (r"\s+([,.;:!?])", "$1"),
    (r"\.\s*:", ". "),
    (r"\s+", " "),
)
# Headings that a model leaks from its prompt, and those that open its answer.
SCAFFOLD = r"instruction|constraints?|excerpt|input\s+summaries|response|book|section|scope|chunk|story\s+so\s+far|chapter\s+summaries|for\s+each\s+person|categories|author|reply\b"
ANSWER = r"summary|character\s+profiles|narrator\s+profile|category"


def lead(k: int = 2) -> Model:
    """The first ``k`` sentences of what follows the last line of a prompt's instructions."""
    return lambda prompts: [" ".join(re.split(r"(?<=[.!?])\s+", p.split("\n\n", 1)[-1].strip())[:k]) for p in prompts]


def chunk_prompt(title: str, chunk: str, story: str) -> str:
    return f"Summarise this part of {title}." + (f" The story so far: {story}" if story else "") + f"\n\n{chunk}"


def reduce_prompt(title: str, parts: list[str]) -> str:
    return f"Join these summaries of {title} into one.\n\n" + " ".join(parts)


def profile_prompt(title: str, author: str, category: str, text: str) -> str:
    """Fiction asks for characters, lives and histories for people, arguments for claims, guides for uses; fiction and lives get a cast, the rest a narrator."""
    asked = {"dramatic": "the characters and how each would speak", "biographical": "the people and how each would speak", "analytical": "the claims and the voice that would argue them", "practical": "the uses and the voice that would teach them"}
    return f"Describe {asked.get(category, asked['dramatic'])} in {title} by {author}.\n\n{text}"


def category_prompt(title: str, summary: str) -> str:
    return f"Name the category of {title}: dramatic, biographical, analytical or practical.\n\n{summary}"


def windows(words: list[str], size: int, overlap: int) -> list[list[str]]:
    step = max(1, size - overlap)
    return [words] if len(words) <= size else [words[i : i + size] for i in range(0, len(words), step)]


def reduced(title: str, parts: list[str], model: Model, window: int = WINDOW_WORDS) -> str:
    """One summary of several: while they don't fit the window they are cut, summarised and tried again.

    None give an empty one, a single one passes through. Where a model's answers are not shorter than what it was asked,
    trying again would never end: the answers of the windows are joined then, so no word is dropped.
    """
    parts = [p for p in parts if p and p.strip()]
    if len(parts) < 2:
        return parts[0] if parts else ""
    while True:
        words = " ".join(f"{i}. {p}" for i, p in enumerate(parts, 1)).split()
        if len(words) <= window or len(parts) == 1:
            return model([reduce_prompt(title, parts)])[0]
        cut = [" ".join(w) for w in windows(words, window, 0)]
        shorter = model([chunk_prompt(title, c, "") for c in cut])
        if sum(len(s.split()) for s in shorter) >= len(words):
            return " ".join(s for s in shorter if s.strip())
        parts = shorter


def fold(title: str, chapters: list[tuple[str, str]], model: Model, done: dict[int, tuple[str, str, int]] | None = None, chunk: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS, window: int = WINDOW_WORDS, least: int = 0) -> list[tuple[int, str, int, str, str]]:
    """(index, title, chunks, summary, story so far) of each chapter; chapters that a checkpoint holds are taken from it.

    Chunks of fewer than ``least`` words are not asked for (LEAST_CHUNK_WORDS suits models behind a network).
    """
    out, summaries, story = [], [], ""
    for i, (name, text) in enumerate(chapters, 1):
        if done and i in done:
            summary, story, n = done[i]
        else:
            parts = windows(text.split(), chunk, overlap)
            asked = [p for p in parts if p and len(p) >= least]
            answers = model([chunk_prompt(title, " ".join(p), story) for p in asked]) if asked else []
            n = len(parts)
            summary = reduced(name, [a for a in answers if a], model, window) if answers else ""
            story = reduced(title, [*summaries, summary], model, window)
        summaries.append(summary)
        out.append((i, name, n, summary, story))
    return out


RESULT = "bookid long, chapter_index int, chapter_title string, chunk_count int, summary string, story_so_far string"


def summarize_books(books: DataFrame, model: Model | None = None, checkpoint: DataFrame | None = None, chunk: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS, window: int = WINDOW_WORDS, least: int = 0) -> DataFrame:
    """RESULT for each chapter of books (bookid, title, text). Chapters in ``checkpoint`` (RESULT) aren't computed again.

    The fold is sequential in a book by its nature and parallel over books; a row holds a book, so no group is gathered.
    """
    run = model or lead()
    rows = books.select(F.col("bookid").cast("long").alias("bookid"), "title", "text")
    if checkpoint is not None:
        kept = checkpoint.groupBy(F.col("bookid").cast("long").alias("_b")).agg(F.collect_list(F.struct("chapter_index", "summary", "story_so_far", "chunk_count")).alias("done"))
        rows = rows.join(kept, F.col("bookid") == F.col("_b"), "left").drop("_b")
    else:
        rows = rows.withColumn("done", F.lit(None).cast("array<struct<chapter_index:int,summary:string,story_so_far:string,chunk_count:int>>"))

    def work(frames):
        for frame in frames:
            found = []
            for r in frame.itertuples(index=False):
                done = {d["chapter_index"]: (d["summary"], d["story_so_far"], d["chunk_count"]) for d in (r.done if r.done is not None else [])}
                found += [(r.bookid, *x) for x in fold(r.title or "", chapters_of(r.text or ""), run, done, chunk, overlap, window, least)]
            yield pd.DataFrame(found, columns=[c.split()[0] for c in RESULT.split(", ")])

    return rows.mapInPandas(work, RESULT)


def unfinished(books: DataFrame, results: DataFrame) -> DataFrame:
    """Books without a result, for resuming."""
    return books.join(results.select("bookid").distinct(), "bookid", "left_anti")


def profile_source(summaries: DataFrame, final: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """bookid and the text that profiles are made of: all chapter summaries if they fit the window, else the final one."""
    joined = summaries.groupBy("bookid").agg(F.array_sort(F.collect_list(F.struct("chapter_index", "summary"))).alias("_s"))
    text = F.array_join(F.transform("_s", lambda s: F.concat(F.lit("[Chapter "), s["chapter_index"].cast("string"), F.lit("] "), s["summary"])), "\n")
    return joined.join(final.select("bookid", F.col("summary").alias("_final")), "bookid", "left").select("bookid", F.when(F.size(F.split(text, r"\s+")) <= window, text).otherwise(F.col("_final")).alias("text"))


def primary_text(answer: Column) -> Column:
    """The answer in a completion: after the first answer heading, before the next one or a leaked heading of the prompt."""
    rest = F.regexp_replace(F.coalesce(answer, F.lit("")), " ", " ")
    parts = F.split(rest, rf"(?im)^\s*#{{3,}}\s*(?:{ANSWER})\s*:?\s*")
    body = F.when(F.size(parts) > 1, F.element_at(parts, 2)).otherwise(F.element_at(parts, 1))
    return F.trim(F.split(body, rf"(?im)^\s*#{{3,}}\s*(?:{SCAFFOLD})")[0], F.lit(" \n\t"))


def normalized_summary(text: Column) -> Column:
    """Tidy model output: placeholders go, operators and ampersands are spaced, brackets and punctuation are single, formulas are marked as such, and all is one line."""
    out = F.regexp_replace(primary_text(text), "\u00a0", " ")
    for pattern, new in TIDY:
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out)


def lexical_ratio(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of two normalised texts."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        norm = lambda t: " ".join(re.sub(r"[^a-z0-9]+", " ", (t or "").lower()).split())
        return pd.Series([difflib.SequenceMatcher(None, norm(x), norm(y)).ratio() for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(run, "double")(a, b)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def contradiction(forward: Column, backward: Column) -> Column:
    return F.greatest(forward, backward)


def passes(semantic: Column, lexical: Column, contradictory: Column, truncated: Column, has_reference: Column) -> Column:
    """Close in meaning and, if worded differently, not contradictory; null where it can't be told."""
    ok = (semantic >= SEMANTIC) & ((lexical >= LEXICAL) | (contradictory < CONTRADICTION))
    return F.when(~truncated & has_reference, ok)
