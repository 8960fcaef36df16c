"""Column conventions: keys, schemas, missing values and composite ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import trimmed

CONTROL = "none"
MODEL_DIMENSIONS = ("run_id", "probe")
CELL_KEYS = ("run_id", "probe", "persona_type", "persona_id", "prompt_type", "prompt_id", "rep")
DESIGN_KEYS = ("persona_type", "persona_id", "prompt_id")
UNIT_KEYS = ("persona_type", "persona_id", "prompt_type", "prompt_id", "rep")
LEAN_COLUMNS = (*CELL_KEYS, "rank", "assumption", "description", "probability", "probability_norm", "parse_status", "has_response")
STRUCTURED_LEAN_COLUMNS = (*CELL_KEYS, "dimension", "score", "explanation", "parse_status", "has_response")
FRAMINGS = ("original_post", "flipped_story")
DIMENSIONS = ("validation_seeking", "user_rightness", "user_information_advantage", "objectivity_seeking")

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
_ATTEMPT = (
    "cell_key string, persona_type string, persona_id string, prompt_type string, prompt_id string, rep int, probe string,"
    " n_assumptions_asked int, n_dimensions_asked int, persona_turns int, persona_recovered boolean, run_id string,"
    " model_ref string, quantization string, temperature double, top_p double, max_output_tokens int, thinking_applied string,"
    " thinking_standardized boolean, raw string, prompt_digest string, error string, timestamp string, schema_version int"
)
ATTEMPT = T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in _ATTEMPT.split(","))])


def present(df: DataFrame, columns: tuple[str, ...] | list[str]) -> list[str]:
    """Those of the columns that the table has, in the order asked for."""
    return [c for c in columns if c in df.columns]


def require(df: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """The table itself, or an error that names the columns it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def cell_id(df: DataFrame) -> Column:
    """One opaque id per response: ``cell_key``, else the design columns joined with bars.

    ``concat_ws`` skips nulls, so nulls are written as empty strings.
    """
    if "cell_key" in df.columns:
        return F.col("cell_key").cast("string")
    keys = present(df, CELL_KEYS)
    if not keys:
        raise ValueError("the table has no column that identifies a cell")
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])


def no_nan(col: Column) -> Column:
    """NaN as null: Spark orders NaN above all numbers and lets it poison averages."""
    return F.when(F.isnan(col), None).otherwise(col)


def control_key(col: Column) -> Column:
    """A cleaned persona key, with every spelling of "nobody" as ``none``."""
    key = trimmed(col)
    return F.when(key.isNull() | key.isin("", CONTROL), F.lit(CONTROL)).otherwise(key)


def clean_keys(df: DataFrame) -> DataFrame:
    """Persona columns with the control's sentinel, prompt ids trimmed and in lower case."""
    out = df
    for c in present(df, ("persona_type", "persona_id")):
        out = out.withColumn(c, control_key(F.col(c)))
    return out.withColumn("prompt_id", trimmed(F.col("prompt_id"))) if "prompt_id" in df.columns else out


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The table itself, or an error if a key occurs twice (one aggregate action)."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate key {twice[0].asDict()}")
    return df


def normalize_label(col: Column) -> Column:
    """Lower case, marks as spaces, without a leading "the user is"; null becomes empty."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(col.cast("string"), F.lit(""))), "[^a-z0-9 ]+", " "))
    # Fixed value: the openings that say nothing.
    text = F.regexp_replace(text, r"^(the\s+)?(user|person|they|he|she)\s+(is|wants|seeks|needs)\s+", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def flag(col: Column) -> Column:
    """A boolean of how files write it: true, 1, yes and t in any case; null and all else are false."""
    return F.coalesce(F.lower(F.trim(col.cast("string"))).isin("true", "1", "1.0", "yes", "t"), F.lit(False))


def level_codes(df: DataFrame, column: str, levels: list[str] | None = None, name: str = "code") -> DataFrame:
    """Add an integer code per level: its place in ``levels``, or in the order of all levels; unknown ones are null.

    The distinct levels are numbered and joined back, so no row is ranked.
    """
    if levels is not None:
        place = F.array_position(F.array(*map(F.lit, levels)), F.col(column)) - 1
        return df.withColumn(name, F.when(place >= 0, place.cast("int")))
    from pyspark.sql import Window as W

    own = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return df.join(own.withColumn(name, F.row_number().over(W.orderBy(column)) - 1), column, "left")


def shared_keys(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = CELL_KEYS) -> list[str]:
    """The keys that both tables have, as far as they follow each other from the first shared one."""
    out: list[str] = []
    for k in keys:
        if k in left.columns and k in right.columns:
            out.append(k)
        elif out:
            break
    if not out:
        raise ValueError("the tables share no key")
    return out


def text_column(df: DataFrame, wanted: str | None = None) -> str:
    """The column that holds the texts: the one asked for, or the first usual name."""
    for c in (wanted,) if wanted else ("text", "response", "description", "assumption", "content"):
        if c in df.columns:
            return c
    raise ValueError(f"no text column in {df.columns}")


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d, null unless the denominator is positive."""
    return F.when(d > 0, n / d)


def union_sources(tables: dict[str, DataFrame], tag: str = "model") -> DataFrame:
    """Stack several sources under a tag column; missing columns are null."""
    out = None
    for alias, df in tables.items():
        part = df.withColumn(tag, F.lit(alias))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source given")
    return out
