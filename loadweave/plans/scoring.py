"""From raw rows or requests to validated, scored and logged forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.config import CHAMPION, FEATURES_V3, FIELD_SPECS, RAW_REQUIRED, Layout
from loadweave.functions.scalar import require_columns
from loadweave.functions.timefn import iso_text, parse_utc, years_since
from loadweave.operators.features import extreme_event_columns, model_input_columns
from loadweave.plans.packaged import LINE, TrendResidualModel
from loadweave.plans.registry import Bundle

TIME_FIELD = "target_timestamp"


def check_fields(features: Sequence[str]) -> None:
    unknown = sorted(set(features) - set(FIELD_SPECS))
    if unknown:
        raise ValueError(f"no field rule for {unknown}")


def _rule(name: str, value: str, present: str, readable: str = "true") -> str:
    """SQL ``case`` naming the first rule a field breaks, else null; arguments are SQL text."""
    kind, low, high = FIELD_SPECS[name]
    whens = [(f"not ({present})", "missing"), (f"not ({readable})", "type")]
    if kind == "int":
        whens.append((f"isnan({value}) or {value} <> floor({value})", "type"))
    bounds = [f"{value} < {float(low)}D"] if low is not None else []
    bounds += [f"{value} > {float(high)}D"] if high is not None else []
    if bounds:
        whens.append((f"isnan({value}) or {' or '.join(bounds)}", "range"))
    return "case " + " ".join(f"when {test} then '{name}:{problem}'" for test, problem in whens) + " end"


def _with_errors(df: DataFrame, rules: Sequence[str], more: Column | None = None) -> DataFrame:
    found = F.expr(f"filter(array({', '.join(rules)}), e -> e is not null)")
    if more is not None:
        found = F.concat(found, more)
    return df.withColumn("errors", F.array_sort(found)).withColumn("is_valid", F.size("errors") == 0)


def validate_columns(df: DataFrame, features: Sequence[str], time_field: str = TIME_FIELD,
                     ignore: Sequence[str] = ()) -> DataFrame:
    """Contract check of typed rows: adds ``errors`` and ``is_valid``.

    Columns in ``ignore`` (series keys) are outside the contract; any other extra column is an error.
    """
    check_fields(features)
    have = set(df.columns)
    rules = [f"case when `{time_field}` is null then '{time_field}:missing' end"
             if time_field in have else f"'{time_field}:missing'"]
    rules += [_rule(n, f"cast(`{n}` as double)", f"`{n}` is not null") if n in have else f"'{n}:missing'"
              for n in features]
    rules += [f"'{n}:extra'" for n in sorted(have - set(features) - {time_field} - set(ignore))]
    return _with_errors(df, rules)


def validate_json(df: DataFrame, payload: str, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Contract check of JSON requests: typed fields, ``errors``, ``is_valid``; extra fields are errors."""
    check_fields(features)

    def text(name: str) -> str:
        return f"try_element_at(_f, '{name}')"

    def number(name: str) -> str:
        # a cast also reads a type letter behind the digits, which is not a number to a client
        suffixed = f"{text(name)} rlike '[0-9.][dDfF][^0-9A-Za-z]*$'"
        return f"case when not ({suffixed}) then try_cast({text(name)} as double) end"

    parsed = df.withColumn("_f", F.from_json(F.col(payload), "map<string,string>"))
    typed = parsed.withColumns({
        **{f"_v_{n}": F.expr(number(n)) for n in features},
        TIME_FIELD: parse_utc(F.expr(text(TIME_FIELD))),
    })
    body = "_f is not null"
    rules = [
        "case when _f is null then 'body:json' end",
        f"case when {body} and {text(TIME_FIELD)} is null then '{TIME_FIELD}:missing' "
        f"when {body} and {TIME_FIELD} is null then '{TIME_FIELD}:type' end",
    ]
    rules += [f"case when {body} then {_rule(n, f'_v_{n}', f'{text(n)} is not null', f'_v_{n} is not null')} end"
              for n in features]
    allowed = ", ".join(f"'{n}'" for n in (*features, TIME_FIELD))
    extra = F.expr(f"transform(array_except(coalesce(map_keys(_f), cast(array() as array<string>)), array({allowed})), "
                   "k -> concat(k, ':extra'))")
    columns = [F.expr(f"try_cast(_v_{n} as {'int' if FIELD_SPECS[n][0] == 'int' else 'double'}) as {n}") for n in features]
    return _with_errors(typed, rules, extra).select(*keep, payload, TIME_FIELD, *columns, "errors", "is_valid")


def request_json(df: DataFrame, features: Sequence[str], ts: str = "timestamp") -> Column:
    """A row as the JSON body of a request."""
    return F.to_json(F.struct(*features, iso_text(F.col(ts)).alias(TIME_FIELD)))


def engineer_with_state(raw: DataFrame, bundle: Bundle, layout: Layout, keep: Sequence[str] = ()) -> DataFrame:
    """Model-ready rows of many series, from each series' own fitted state."""
    require_columns(raw, [*RAW_REQUIRED, layout.ts])
    joined = raw.join(bundle.state, list(layout.keys))
    out = joined.withColumn("trend_idx", years_since(F.col(layout.ts), F.col("trend_origin"))).withColumns(
        extreme_event_columns(F.col("heat"), F.col("cold"), F.col("precip")))
    features = list(FEATURES_V3)
    if bundle.use_holiday:
        known = F.when(F.col("holiday_name").isNotNull(), F.try_element_at("holiday_freq_map", F.col("holiday_name")))
        out = out.withColumn("holiday_freq", F.coalesce(known, F.lit(0.0)))
        features.append("holiday_freq")
    return out.select(*layout.keys, *keep, F.col(layout.ts).alias(TIME_FIELD), *model_input_columns(features))


def predict(df: DataFrame, bundle: Bundle, layout: Layout) -> DataFrame:
    """Trend plus residual; ``df`` carries the keys and the model inputs, and the line if the state was joined before."""
    return TrendResidualModel(state=bundle.state, residual=bundle.residual_model, keyCols=list(layout.keys)).transform(df)


def respond(scored: DataFrame, bundle: Bundle, keep: Sequence[str] = ()) -> DataFrame:
    return scored.select(
        *keep, TIME_FIELD, "predicted_load_mw",
        F.lit(bundle.name).alias("model_name"), F.lit(str(bundle.version)).alias("model_version"),
        F.lit(CHAMPION).alias("model_alias"), F.current_timestamp().alias("predicted_at"))


def score_batch(raw: DataFrame, bundle: Bundle, layout: Layout) -> tuple[DataFrame, DataFrame]:
    """Raw slice -> (responses, rejected rows)."""
    inputs = model_input_columns(bundle.features)
    rows = engineer_with_state(raw, bundle, layout, keep=LINE)
    checked = validate_columns(rows, inputs, ignore=(*layout.keys, *LINE))
    scored = predict(checked.where("is_valid").drop("errors", "is_valid"), bundle, layout)
    return respond(scored, bundle, layout.keys), checked.where(~F.col("is_valid")).drop(*LINE)


def batch_summary(responses: DataFrame, rejected: DataFrame) -> DataFrame:
    """How many rows of the batch succeeded and how many were refused."""
    marks = responses.select(F.lit(1).alias("ok")).unionByName(rejected.select(F.lit(0).alias("ok")))
    return marks.agg(F.coalesce(F.sum("ok"), F.lit(0)).alias("n_scored"), F.count(F.lit(1)).alias("n_rows"))
