import posixpath

import pytest
from pyspark.sql import functions as F

from latewing.functions import texts


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("given,want", [
    ("what", "Question: what<end_of_utterance>"), ("\t what \n", "Question: what<end_of_utterance>"), ("Question:x", "Question:x<end_of_utterance>"),
    ("question: x", "Question: question: x<end_of_utterance>"), ("x<end_of_utterance>", "Question: x<end_of_utterance>"), (" x ", "Question: x<end_of_utterance>"),
])
def test_format_query(spark, given, want):
    assert one(spark, texts.format_query, given) == want


def test_format_prompt(spark):
    assert one(spark, texts.format_prompt, "see") == "<|im_start|>User:<image>see<end_of_utterance>"
    assert one(spark, texts.format_prompt, "<|im_start|>as it is") == "<|im_start|>as it is"


@pytest.mark.parametrize("path", ["/a/b.pdf", "a/", "a", "/", "//x/y", "///x", "a/../../b", "/../a", "./a//b/./c", "", ".", "..", "a/.."])
def test_paths(spark, path):
    assert one(spark, texts.basename, path) == posixpath.basename(path)
    assert one(spark, texts.normal_path_column, path) == posixpath.normpath(path)
