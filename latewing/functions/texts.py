"""Column functions over query texts, prompts and paths."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the encoder's text format.
QUESTION, QUESTION_PREFIX, SUFFIX = "Question:", "Question: ", "<end_of_utterance>"
PROMPT_START, PROMPT_USER, PROMPT_END = "<|im_start|>", "<|im_start|>User:<image>", "<end_of_utterance>"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def format_query(text: Column) -> Column:
    """Stripped, after ``Question: `` unless it starts with ``Question:``, ended once."""
    text = strip(text)
    text = F.when(text.startswith(QUESTION), text).otherwise(F.concat(F.lit(QUESTION_PREFIX), text))
    return F.when(text.endswith(SUFFIX), text).otherwise(F.concat(text, F.lit(SUFFIX)))


def format_prompt(text: Column) -> Column:
    """A page prompt in its tags; a text that already starts with the tag passes."""
    return F.when(text.startswith(PROMPT_START), text).otherwise(F.concat(F.lit(PROMPT_USER), text, F.lit(PROMPT_END)))


def basename(path: Column) -> Column:
    """What follows the last slash; empty if the path ends in one."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def is_blank(text: str) -> bool:
    return not text.strip()


def normal_path(path: str) -> str:
    """POSIX normal form, for lookups by path on the driver."""
    return posixpath.normpath(path)


def normal_path_column(path: Column) -> Column:
    """The same for a column: empty and ``.`` parts dropped, ``..`` takes the part before it, one or two leading slashes kept."""
    rooted = path.startswith("/")
    lead = F.when(path.rlike("^//(?!/)"), F.lit("//")).when(rooted, F.lit("/")).otherwise(F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(kept: Column, part: Column) -> Column:
        top = F.get(kept, F.size(kept) - 1)
        up = part == ".."
        return (
            F.when(up & (F.size(kept) > 0) & (top != ".."), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .when(up & rooted, kept)
            .otherwise(F.concat(kept, F.array(part)))
        )

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    made = F.concat(lead, joined)
    return F.when(made == "", F.lit(".")).otherwise(made)
