"""Bulk-import payloads (JSON) as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipledger.schemas import SCHEMAS


class EmptyPayload(ValueError):
    """The payload holds no rows (the original answered 400 'no data')."""


def _request_text(name: str) -> F.Column:
    """A request value (variant) as text, NULL where it is falsy by its JSON type."""
    v = F.col(name)
    text = F.try_variant_get(v, "$", "string")
    kind = F.schema_of_variant(v)
    return (F.when(kind == "STRING", text).when(kind == "BOOLEAN", F.when(text == "true", text))
             .when(F.try_variant_get(v, "$", "double") == 0, F.lit(None).cast("string")).otherwise(text))


def read_import(spark: SparkSession, path: str, table: str, wrapped: bool = True, check_empty: bool = True
                ) -> DataFrame:
    """Read an import payload with the request table's explicit schema.

    ``wrapped``: each JSON document is ``{"rows": [...], ...}`` (the request body form), exploded to one row
    per entry; the document's other top-level fields (warehouse_id, document_reference) are carried along.
    Otherwise the files are JSON lines, one row each. Values become text; a JSON number 0, false or null becomes
    NULL, since the import rules take a falsy value as missing (the text '0' is not falsy and stays).
    A document that cannot be parsed fails the import; it is never skipped.
    """
    names = SCHEMAS[table].fieldNames()
    texts = {f.name for f in SCHEMAS[table] if f.dataType == T.StringType()}
    row_schema = T.StructType([T.StructField(f.name, T.VariantType() if f.name in texts else f.dataType)
                               for f in SCHEMAS[table]])
    if wrapped:
        doc = T.StructType([T.StructField("rows", T.ArrayType(row_schema)),
                            T.StructField("warehouse_id", T.StringType()),
                            T.StructField("document_reference", T.StringType())])
        df = spark.read.schema(doc).option("multiLine", "true").option("mode", "FAILFAST").json(path)
        df = df.select("warehouse_id", "document_reference", F.explode("rows").alias("r")).select(
            "warehouse_id", "document_reference", "r.*")
    else:
        df = spark.read.schema(row_schema).option("mode", "FAILFAST").json(path)
    df = df.select(*[c for c in df.columns if c not in names], *[_request_text(n).alias(n) if n in texts else n for n in names])
    if check_empty and df.limit(1).count() == 0:
        raise EmptyPayload(path)
    return df


def read_import_documents(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, DataFrame]:
    """S2 with an outcome per document: (rows of the good documents with their ``document``, ``document, outcome, rows``).

    A document is 'parsed', 'empty' (an object without rows: the original's 400) or 'corrupt' (no JSON, no object, or ``rows``
    that is no list); one bad document costs itself, not the import. Documents are request bodies (10 MB at most in the
    original), so each is one value; many of them are spread over tasks. Rows are rejected by the import operators."""
    names = SCHEMAS[table].fieldNames()
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("document"),
                                                        F.try_parse_json("value").alias("body"))
    docs = docs.withColumn("list", F.try_variant_get("body", "$.rows", "array<variant>"))
    kind = F.schema_of_variant("body")
    given = F.try_variant_get("body", "$.rows", "variant")
    listed = F.filter("list", lambda r: r.isNotNull())
    outcome = (F.when(F.col("body").isNull() | ~kind.startswith("OBJECT"), "corrupt")
               .when(given.isNull() | (F.schema_of_variant(given) == "VOID"), "empty")
               .when(F.col("list").isNull(), "corrupt").when(F.size("list") == 0, "empty").otherwise("parsed"))
    docs = docs.select("document", outcome.alias("outcome"), listed.alias("list"),
                       *[F.try_variant_get("body", f"$.{c}", "string").alias(c) for c in ("warehouse_id", "document_reference")])
    good = docs.where("outcome = 'parsed'").select("document", "warehouse_id", "document_reference", F.explode("list").alias("r"))
    fields = {n: F.try_variant_get("r", f"$.{n}", "variant") for n in names}
    good = good.select("document", *[c for c in ("warehouse_id", "document_reference") if c not in names],
                       *[v.alias(n) for n, v in fields.items()])
    texts = {f.name for f in SCHEMAS[table] if f.dataType == T.StringType()}
    rows = good.select(*[c for c in good.columns if c not in names],
                       *[_request_text(n).alias(n) if n in texts else F.try_variant_get(n, "$", SCHEMAS[table][n].dataType.simpleString()).alias(n)
                         for n in names])
    return rows, docs.select("document", "outcome", F.when(F.col("outcome") == "parsed", F.size("list")).otherwise(0).alias("rows"))
