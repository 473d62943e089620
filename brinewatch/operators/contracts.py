"""Range and field contracts: marking, splitting and counting violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewatch import schema as S
from brinewatch.functions import in_range


#: JSON tokens that a type allows, by the names they have in a variant.
JSON_TOKENS = {
    "string": "^STRING$", "int": "^BIGINT$", "bigint": "^BIGINT$", "double": "^(BIGINT|DOUBLE|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
}


def mark_valid(df: DataFrame, columns: Sequence[str] = S.SENSORS) -> DataFrame:
    return df.withColumn("schema_valid", in_range(columns))


def valid_rows(df: DataFrame, columns: Sequence[str] = S.SENSORS) -> DataFrame:
    return df.where(in_range(columns))


def rejected_rows(df: DataFrame, columns: Sequence[str] = S.SENSORS) -> DataFrame:
    """The rows ``valid_rows`` drops, with the names of the offending sensors."""
    offending = F.array_compact(F.array(*[F.when(~in_range([c]), F.lit(c)) for c in columns]))
    return df.where(~in_range(columns)).withColumn("violations", F.array_join(offending, ","))


def contract_violations(
    messages: DataFrame,
    *,
    value: str = "value",
    fields: Mapping[str, tuple[str, str]] = S.EVENT_FIELDS,
    required: Sequence[str] = S.CONTRACT_REQUIRED,
    enums: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Per required field: messages where it is missing, of the wrong type or outside its enum.

    Unparsable messages count as missing everything, JSON nulls as missing.  Types are those of the JSON
    tokens: a number is no string, a quoted number no number.  One aggregate over all fields.
    """
    enums = enums or {}
    wanted = {field: kind for field, (column, kind) in fields.items() if column in required}
    wanted.update({field: "string" for field in enums if field not in wanted})
    parsed = messages.select(F.try_parse_json(F.col(value)).alias("m"))
    counts, rows = [F.count(F.lit(1)).alias("_messages")], []
    for i, (field, kind) in enumerate(wanted.items()):
        path = f"$['{field}']"
        token = F.schema_of_variant(F.try_variant_get("m", path, "variant"))
        there = F.coalesce(token != "VOID", F.lit(False))
        typed = token.rlike(JSON_TOKENS.get(kind, "")) & F.try_variant_get("m", path, kind).isNotNull()
        text = F.try_variant_get("m", path, "string")
        outside = there & ~text.isin(*enums[field]) if field in enums else F.lit(False)
        counts += [
            F.count_if(~there).alias(f"_m{i}"),
            F.count_if(there & ~typed).alias(f"_t{i}"),
            F.count_if(F.coalesce(outside, F.lit(False))).alias(f"_e{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(field).alias("field"), F.col("_messages").alias("messages"),
                F.col(f"_m{i}").alias("missing"), F.col(f"_t{i}").alias("wrong_type"),
                F.col(f"_e{i}").alias("outside_enum"),
            )
        )
    return parsed.agg(*counts).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
