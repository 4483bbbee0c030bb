"""Answers from hits: prompt, labels, and the ladder of outcomes. The language model is an interface."""

from __future__ import annotations

import base64
import io
from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "Answer the question from the document pages shown. Name the pages that the answer rests on; say so if they do not hold it."


class Answerer(Protocol):
    """A model that reads page images. ``generate`` returns None if it has no answer."""

    def is_available(self) -> bool: ...

    def generate(self, query: str, labels: Sequence[str], images: Sequence[bytes]) -> str | None: ...


class NoAnswerer:
    """The default, offline."""

    def is_available(self) -> bool:
        return False

    def generate(self, query: str, labels: Sequence[str], images: Sequence[bytes]) -> str | None:
        return None


def label(rank: Column, filename: Column, page: Column) -> Column:
    """What stands before a page's image in the prompt."""
    return F.concat(F.lit("[Document Page "), rank.cast("string"), F.lit(" | File: "), filename, F.lit(" | Page: "), page.cast("string"), F.lit("]"))


def labelled(hits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Hits with their rank and label; labels stay with their page whatever images are missing."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "file_path", "page_number")
    ranked = hits.withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("label", label(F.col("rank"), F.col("filename"), F.col("page_number")))


def prompts(hits: DataFrame, query: Column, keys: Sequence[str]) -> DataFrame:
    """One prompt per group of hits: instruction, labels in order of rank, question."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"])
    made = F.concat_ws("\n", F.lit(SYSTEM), F.array_join(lines, "\n"), F.concat(F.lit("Question: "), query))
    return labelled(hits, keys).groupBy(*keys).agg(made.alias("prompt"))


def outcome(n_hits: Column, key: Column, n_images: Column, answer: Column) -> Column:
    """no_results, fallback_pages_only or success."""
    has_key = F.length(F.trim(F.coalesce(key, F.lit("")))) > 0
    return (
        F.when(n_hits == 0, "no_results")
        .when(~has_key | (n_images == 0) | answer.isNull(), "fallback_pages_only")
        .otherwise("success")
    )


def image_part(image: bytes, quality: int = 85) -> dict[str, str]:
    """An image as a part of a request: mime type and base64.  Where Pillow is installed it is made a JPEG without
    transparency; else PNG, JPEG and WebP go as they are."""
    try:
        from PIL import Image
    except ImportError:
        kinds = {b"\x89PNG": "image/png", b"\xff\xd8\xff": "image/jpeg", b"RIFF": "image/webp"}
        mime = next((m for head, m in kinds.items() if image.startswith(head)), None)
        if mime is None:
            raise ValueError("neither PNG, JPEG nor WebP") from None
        return {"mime_type": mime, "data": base64.b64encode(image).decode()}
    out = io.BytesIO()
    Image.open(io.BytesIO(image)).convert("RGB").save(out, "JPEG", quality=quality)
    return {"mime_type": "image/jpeg", "data": base64.b64encode(out.getvalue()).decode()}


def query_and_answer(query: str, hits: DataFrame, images: dict[tuple[str, int], bytes], answerer: Answerer) -> dict:
    """The answer to one query over its few hits, with sources and status."""
    rows = [r.asDict() for r in labelled(hits).orderBy("rank").collect()]
    for r in rows:
        r["image_available"] = (r["file_path"], r["page_number"]) in images
    out = {"query": query, "answer": None, "sources": rows, "status": "fallback_pages_only", "engine": "latewing", "fallback_reason": None}
    if not rows:
        return out | {"status": "no_results", "fallback_reason": "no page matches"}
    if not answerer.is_available():
        return out | {"fallback_reason": "no answering model is configured"}
    shown = [r for r in rows if r["image_available"]]
    if not shown:
        return out | {"fallback_reason": "no page image could be read"}
    answer = answerer.generate(query, [r["label"] for r in shown], [images[r["file_path"], r["page_number"]] for r in shown])
    if answer is None:
        return out | {"fallback_reason": "the model gave no answer"}
    return out | {"answer": answer.strip(), "status": "success"}
