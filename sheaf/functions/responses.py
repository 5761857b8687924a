"""Conversion responses and requests.

Responses are JSON documents; ``parse_json`` gives a variant, so
``document.json_content`` can be a string in one row and an object in another.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("md", "json", "html", "text")
FORMAT_ALIASES = {"markdown": "md"}


def _pretty_text(s: pd.Series) -> pd.Series:
    """Small per-row helper: JSON text -> 2-space indented, non-ASCII kept."""
    return s.map(lambda t: None if t is None else json.dumps(json.loads(t), indent=2, ensure_ascii=False))


def _pretty(c: Column) -> Column:
    # Built on use: a pandas UDF needs an active session.
    return F.pandas_udf(_pretty_text, "string")(c)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """One response document per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("response"))


def scan_responses(responses: DataFrame) -> DataFrame:
    """The typed columns of response documents (columns of ``read_responses``), whatever shapes their parts have.

    ``json_kind`` says what ``document.json_content`` is: OBJECT, ARRAY, STRING, another variant type, or VOID where there is none. A
    document that is no JSON has nulls and ``valid`` false.
    """
    v = F.col("v")
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    kind = F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, "$.document.json_content", "variant")), "^([A-Z]+)", 1)
    return responses.select("source", F.try_parse_json("response").alias("v")).select(
        "source", v.isNotNull().alias("valid"), get("$.status").alias("status"), get("$.processing_time", "double").alias("processing_time"),
        F.size(F.try_variant_get(v, "$.errors", "array<string>")).alias("n_errors"),
        F.coalesce(F.when(kind != "", kind), F.lit("VOID")).alias("json_kind"), get("$.document.md_content").alias("md_content"))


def normalise_format(fmt: Column) -> Column:
    f = F.lower(fmt)
    for a, b in FORMAT_ALIASES.items():
        f = F.when(f == a, F.lit(b)).otherwise(f)
    return f


def select_content(response: Column, output_format: Column) -> Column:
    """The text a client keeps from a response.

    Returns a struct (content, error). status 'failure' -> error with the error
    list; 'json' -> json_content (a string as is, an object indented), falling
    back to md_content when empty; md/html/text -> that content ('' when
    missing); any other format -> md_content.
    """
    v = F.try_parse_json(response)
    get = lambda p: F.try_variant_get(v, p, "string")
    jc = F.try_variant_get(v, "$.document.json_content", "variant")
    jtype = F.schema_of_variant(jc)
    is_struct = jtype.startswith("OBJECT") | jtype.startswith("ARRAY")
    json_text = F.when(is_struct, _pretty(F.to_json(jc))).otherwise(F.try_variant_get(jc, "$", "string"))
    fmt = normalise_format(output_format)
    md = F.coalesce(get("$.document.md_content"), F.lit(""))
    content = (F.when(fmt == "json", F.when(F.coalesce(F.length(json_text), F.lit(0)) > 0, json_text).otherwise(md))
               .when(fmt == "md", md)
               .when(fmt == "html", F.coalesce(get("$.document.html_content"), F.lit("")))
               .when(fmt == "text", F.coalesce(get("$.document.text_content"), F.lit("")))
               .otherwise(md))
    failed = get("$.status") == "failure"
    errors = F.coalesce(F.to_json(F.try_variant_get(v, "$.errors", "variant")), F.lit("[]"))
    return F.struct(F.when(failed, F.lit(None)).otherwise(content).alias("content"),
                    F.when(failed, F.concat(F.lit("Conversion failed: "), errors)).alias("error"),
                    F.try_variant_get(v, "$.processing_time", "double").alias("processing_time"))


def request_v1(request: Column) -> Column:
    """P20: a request in either shape -> v1 ``sources`` (JSON text).

    v0 ``http_sources[{url}]`` become ``{kind: http, url}``, v0
    ``file_sources[{base64_string, filename}]`` become ``{kind: base64, ...}``;
    v1 ``sources`` pass through; all three may mix, in that order.
    """
    schema = ("struct<sources: array<struct<kind: string, url: string, base64_string: string, filename: string>>,"
              " http_sources: array<struct<url: string>>,"
              " file_sources: array<struct<base64_string: string, filename: string>>,"
              " options: map<string, string>>")
    r = F.from_json(request, schema)
    mk = lambda kind, url, b64, fn: F.struct(F.lit(kind).alias("kind"), url.alias("url"), b64.alias("base64_string"),
                                             fn.alias("filename"))
    http = F.transform(F.coalesce(r["http_sources"], F.array()), lambda s: mk(
        "http", s["url"], F.lit(None).cast("string"), F.lit(None).cast("string")))
    files = F.transform(F.coalesce(r["file_sources"], F.array()), lambda s: mk(
        "base64", F.lit(None).cast("string"), s["base64_string"], s["filename"]))
    v1 = F.coalesce(r["sources"], F.array().cast(
        "array<struct<kind: string, url: string, base64_string: string, filename: string>>"))
    return F.to_json(F.struct(F.concat(v1, http, files).alias("sources"), r["options"].alias("options")))
