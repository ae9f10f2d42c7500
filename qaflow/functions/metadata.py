"""Run summaries of any shape: JSON as VARIANT, looked up by path, with defaults for what is missing or of another type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qaflow.functions.strings import strip

#: How the type of a value is named by Spark, as a prefix, and here.
KINDS = {"VOID": "null", "BOOLEAN": "boolean", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "STRING": "string", "ARRAY": "array", "OBJECT": "object"}
#: The Spark type that values of a kind are read as.
TYPES = {"boolean": "boolean", "integer": "long", "number": "double", "string": "string"}


def document(text: Column) -> Column:
    """The JSON of a text as VARIANT; null where the text is null or no JSON."""
    return F.try_parse_json(text)


def kind(doc: Column, path: str) -> Column:
    """Kind of the value at a path like ``$.args.lr``: one of the values of ``KINDS``, or ``missing``, as where a step on the way is no object."""
    named = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    return F.coalesce(*[F.when(named.startswith(k), v) for k, v in KINDS.items()], F.when(named.isNull(), "missing"), F.lit("other"))


def value(doc: Column, path: str, of: str, default=None) -> Column:
    """The value at a path if it is of the kind ``of`` (an integer is a number too), else ``default``: what is missing, null or of another type, "5" for a number, is never converted."""
    found = kind(doc, path)
    fits = found.isin("integer", "number") if of == "number" else found == of
    return F.coalesce(F.when(fits, F.try_variant_get(doc, path, TYPES[of])), F.lit(default).cast(TYPES[of]))


def texts(doc: Column, path: str) -> Column:
    """The items of the array at a path as texts, null ones left out; null where there is no array."""
    items = F.when(kind(doc, path) == "array", F.try_variant_get(doc, path, "array<string>"))
    return F.filter(items, lambda x: x.isNotNull())


def summary(text: Column) -> Column:
    """struct<train_rows, prompt_versions, allowed_versions, args> of a run's summary, as ``validation.metadata_errors`` takes them.

    ``train_rows`` has to be an integer; the lists have to be arrays; ``args`` is an empty map where there is no object, and its
    values are texts, null ones null.
    """

    def of(doc: Column) -> Column:
        args = F.when(kind(doc, "$.args") == "object", F.try_variant_get(doc, "$.args", "map<string,string>"))
        return F.struct(
            value(doc, "$.train_rows", "integer").alias("train_rows"), texts(doc, "$.prompt_versions_filter").alias("prompt_versions"),
            texts(doc, "$.train_prompt_version_filter.allowed").alias("allowed_versions"), F.coalesce(args, F.create_map().cast("map<string,string>")).alias("args"),
        )

    return of(document(text))


def group(text: Column) -> Column:
    """The single listed version of a summary, else the single one among its arguments (a comma list or any scalar), else null."""
    doc = document(text)
    clean = lambda xs: F.filter(F.transform(xs, strip), lambda x: x != "")
    listed = clean(texts(doc, "$.prompt_versions_filter"))
    given = F.when(~kind(doc, "$.args.prompt_versions").isin("missing", "array", "object", "null"), F.try_variant_get(doc, "$.args.prompt_versions", "string"))
    tokens = clean(F.split(given, ","))
    return F.when(F.size(listed) == 1, F.get(listed, 0)).when(F.size(tokens) == 1, F.get(tokens, 0))
