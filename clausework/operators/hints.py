"""Rules that hold a constraint's operator, values, unit and datatype against a vocabulary's hints."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.functions.names import xsd_valid
from clausework.model import XSD
from clausework.sources.shared import cut, sent

#: Patterns and texts beyond these lengths are not tried: the regular expressions come from others.
PATTERN_CHARS, TEXT_CHARS = 2048, 1024


def with_hints(constraints: DataFrame, hints: DataFrame) -> DataFrame:
    """``constraints`` (left_iri) with datatype, bounds, pattern and closed of their left operand."""
    cols = [F.col(c).alias(f"h_{c}") for c in hints.columns]
    return constraints.join(hints.select(*cols), F.col("left_iri") == F.col("h_left_iri"), "left")


def _number(x: Column) -> Column:
    return F.when(F.trim(x).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.trim(x)).try_cast("double")


def _moment(x: Column) -> Column:
    return F.trim(x).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}")


class Compared(NamedTuple):
    """A literal with its number, if it is one, and whether it begins as a date."""

    text: Column
    number: Column
    moment: Column


def _less(a: Compared, b: Compared) -> Column:
    n = F.least(F.length(F.trim(a.text)), F.length(F.trim(b.text)))
    head = lambda x: F.substring(F.trim(x.text), F.lit(1), n)
    return F.coalesce(F.when(a.number.isNotNull(), a.number < b.number).when(a.moment & b.moment, head(a) < head(b)), F.lit(False))


def outside(value: Compared, low: Compared, high: Compared) -> Column:
    """Numbers as numbers, dates and times as texts up to the shorter one's length; what is neither, or not of one kind, is not outside."""
    return low.text.isNotNull() & _less(value, low) | high.text.isNotNull() & _less(high, value)


def outside_bounds(value: Column, low: Column, high: Column) -> Column:
    return outside(*[Compared(x, _number(x), _moment(x)) for x in (value, low, high)])


def unicode_pattern(pattern: Column) -> Column:
    """Digits, white space and word characters of a pattern as those of Unicode, of XML and of Unicode."""
    for escape, meant in ((r"d", r"\\p{Nd}"), (r"D", r"\\P{Nd}"), (r"s", r"[ \\t\\r\\n]"), (r"S", r"[^ \\t\\r\\n]"), (r"w", r"[\\p{L}\\p{M}\\p{Nd}_]"), (r"W", r"[^\\p{L}\\p{M}\\p{Nd}_]")):
        pattern = F.regexp_replace(pattern, rf"(?<!\\)((?:\\\\)*)\\{escape}", rf"$1{meant}")
    return pattern


def pattern_mismatch(value: Column, pattern: Column, flags: Column | None = None) -> Column:
    """Whether a value has nothing that a pattern finds; with the flag ``i`` case does not count."""
    pattern = unicode_pattern(pattern)
    if flags is not None:
        pattern = F.concat(F.when(F.coalesce(flags, F.lit("")).contains("i"), "(?iu)").otherwise(""), pattern)
    return _unlike(value, pattern)


def _unlike(value: Column, pattern: Column) -> Column:
    usable = pattern.isNotNull() & (F.length(pattern) <= PATTERN_CHARS) & (F.length(value) <= TEXT_CHARS)
    return F.when(usable, ~F.rlike(value, pattern)).otherwise(F.lit(False))


def xsd_iri(datatype: Column) -> Column:
    return F.when(datatype.startswith("xsd:"), F.concat(F.lit(XSD), F.substr(datatype, F.lit(5)))).otherwise(datatype)


def _written(df: DataFrame, name: str, other: str) -> Column:
    """A term as the policy has it, if that is known."""
    return F.col(name if name in df.columns else other)


def _optional(df: DataFrame, name: str, default: bool = False) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def same_text_keys(text: Column) -> Column:
    """Keys that two literals share when they are the same as texts or as finite numbers."""
    number = F.trim(text).try_cast("double")
    finite = F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")), F.concat(F.lit("n"), (number + F.lit(0.0)).cast("string")))
    return F.array_compact(F.array(F.concat(F.lit("t"), text), finite))


def listed_values(rows: DataFrame, values: DataFrame) -> DataFrame:
    """``rows`` (left_iri, raw, value_any) with val_listed, as_iri and as_text: whether their operand has a list, and whether the value is on it as an IRI or as a literal.

    Members are joined on (operand, key), so no list is searched, however long.
    """
    literal = _optional(values, "literal")
    some = values.select(F.col("left_iri").alias("val_l")).distinct().withColumn("val_listed", F.lit(True))
    iris = values.where(~literal).select(F.col("left_iri").alias("iri_l"), F.col("value").alias("iri_v")).distinct().withColumn("as_iri", F.lit(True))
    texts = values.where(literal).select(F.col("left_iri").alias("text_l"), F.explode(same_text_keys(F.col("value"))).alias("text_k")).distinct()
    keys = same_text_keys(F.col("raw"))
    wide = (
        rows.join(some, F.col("left_iri") == F.col("val_l"), "left")
        .join(iris, (F.col("left_iri") == F.col("iri_l")) & (F.col("value_any") == F.col("iri_v")), "left")
        .withColumn("key_t", F.get(keys, F.lit(0)))
        .withColumn("key_n", F.get(keys, F.lit(1)))
    )
    for k in ("key_t", "key_n"):
        member = texts.select(F.col("text_l").alias(f"{k}_l"), F.col("text_k").alias(f"{k}_k")).withColumn(f"{k}_on", F.lit(True))
        wide = wide.join(member, (F.col("left_iri") == F.col(f"{k}_l")) & (F.col(k) == F.col(f"{k}_k")), "left").drop(f"{k}_l", f"{k}_k")
    no = F.lit(False)
    as_text = F.coalesce("key_t_on", no) | F.coalesce("key_n_on", no)
    found = wide.withColumns({"val_listed": F.coalesce("val_listed", no), "as_iri": F.coalesce("as_iri", no), "as_text": as_text})
    return found.drop("val_l", "iri_l", "iri_v", "key_t", "key_n", "key_t_on", "key_n_on")


def hint_findings(constraints: DataFrame, hints: DataFrame, operators: DataFrame, values: DataFrame, units: DataFrame, gaps: DataFrame, strict: bool = True) -> DataFrame:
    """doc_id, policy_ix, path, left_iri, rule, closed, written: each constraint (left_iri, op_iri, value_iri, value_any, unit_iri) against its hints.

    Lists are never searched per row: a list is joined on its own key, and the
    absence of a match is the finding.  A literal is held against the list of its
    own operand only, and only if that is closed.  ``gaps`` (doc_id, policy_ix) are
    policies with a declared profile that is not loaded, which may add values
    narrower than a closed list's: there an IRI outside of it is no finding, unless
    the list is exact.  ``hints`` may say ``values_only`` (closed for values alone) and
    ``values_exact``, ``values`` which members are literals.
    """
    met = cut(constraints.select("left_iri").where("left_iri is not null").distinct(), "operands")  # few operands, each of them often
    # What patterns and bounds are is settled once for each hint, not for each constraint.
    bounds = {f"{b}_{kind}": of(F.col(b)) for b in ("lo", "hi") for kind, of in (("number", _number), ("moment", _moment))}
    hints = hints.withColumns(bounds | {"meant": unicode_pattern(F.col("pattern"))})
    hints, values = (sent(df.join(met, "left_iri", "left_semi"), name) for df, name in ((hints, "hints"), (values, "values")))
    wide = with_hints(constraints, hints)
    for df, key, col, name in ((operators, "op", "operator_name", "op"), (units, "unit", "unit_iri", "unit")):
        some = df.select(F.col("left_iri").alias(f"{name}_l")).distinct().withColumn(f"{name}_listed", F.lit(True))
        pair = df.select(F.col("left_iri").alias(f"{name}_l2"), F.col(key).alias(f"{name}_v"))
        wide = wide.join(some, F.col("left_iri") == F.col(f"{name}_l"), "left").join(
            pair, (F.col("left_iri") == F.col(f"{name}_l2")) & (F.col(col) == F.col(f"{name}_v")), "left"
        )
    wide = listed_values(wide, values)
    literal, iri = F.col("right_kind") == "literal", F.col("right_kind") == "iri"
    # The same of values, and only where they are held against bounds.
    bound = literal & (F.col("h_lo").isNotNull() | F.col("h_hi").isNotNull())
    wide = wide.withColumns({"raw_number": F.when(bound, _number(F.col("raw"))), "raw_moment": F.when(bound, _moment(F.col("raw")))})
    compared = lambda x: Compared(F.col(x), F.col(f"{x}_number"), F.col(f"{x}_moment"))
    out_of_bounds = bound & outside(compared("raw"), compared("h_lo"), compared("h_hi"))
    closed = F.coalesce("h_closed", F.lit(False))
    binds = closed & ~_optional(wide, "h_values_only")
    want = F.col("h_datatype")
    own_valid, want_valid = xsd_valid(F.col("datatype"), F.col("raw")), xsd_valid(want, F.col("raw"))
    hinted_same = F.coalesce(xsd_iri(F.col("datatype")) == xsd_iri(want), F.lit(False))
    held_back = closed & F.lit(strict) & ~_optional(wide, "h_values_exact")  # if its policy has a gap
    on_list = F.col("val_listed")
    lexical = literal & F.col("h_pattern").isNotNull() & ((F.length("h_pattern") > PATTERN_CHARS) | (F.length("raw") > TEXT_CHARS))
    cases = [
        (F.col("op_listed") & F.col("op_v").isNull(), "prose.operator-not-allowed", binds, _written(wide, "operator", "operator_name")),
        (literal & ~want_valid, "prose.datatype-lexical", binds),
        (iri & on_list & ~F.col("as_iri"), "prose.value-not-allowed", closed, F.col("raw"), held_back),
        (literal & on_list & closed & ~F.col("as_text") & ~F.col("as_iri"), "prose.value-not-allowed", closed, F.col("raw")),
        (literal & on_list & closed & ~F.col("as_text") & F.col("as_iri"), "prose.iri-expected", F.lit(True), F.col("raw")),
        (literal & (_unlike(F.col("raw"), F.col("h_meant")) | out_of_bounds), "prose.value-not-allowed", closed),
        (lexical, "input.unchecked", F.lit(False)),
        (F.col("unit_listed") & F.col("unit_iri").isNotNull() & F.col("unit_v").isNull(), "prose.unit-not-allowed", binds, _written(wide, "unit", "unit_iri")),
        (literal & F.col("datatype").isNotNull() & want.isNotNull() & ~hinted_same, "prose.datatype-conflict", binds),
        (literal & F.col("datatype").isNotNull() & ~hinted_same & ~own_valid, "prose.ill-typed-literal", F.lit(False)),
    ]
    none = F.lit(None).cast("string")
    found = []
    for test, rule, shut, *more in cases:
        term, held = (more[0] if more else none), (more[1] if len(more) > 1 else F.lit(False))
        found.append(F.when(test, F.struct(F.lit(rule).alias("rule"), shut.alias("closed"), term.alias("written"), held.alias("held"))))
    # Only what is found is dealt by policy, never all constraints.
    every = wide.select("doc_id", "policy_ix", "path", "left_iri", F.inline(F.array_compact(F.array(*found))))
    open_ = gaps.select(F.col("doc_id").alias("gap_doc"), F.col("policy_ix").alias("gap_ix")).distinct()
    kept = every.join(open_, F.col("held") & (F.col("doc_id") == F.col("gap_doc")) & (F.col("policy_ix") == F.col("gap_ix")), "left_anti")
    return kept.select("doc_id", "policy_ix", "path", "left_iri", "rule", "closed", "written")


def disallowed_values(right_values: DataFrame, allowed: DataFrame) -> DataFrame:
    """Right values (left_iri, iri, raw) of operands with a list that match none of it: by IRI, by text, by number.

    Three anti-joins on equality, as the three notions of equality need.
    """
    listed = right_values.join(allowed.select("left_iri").distinct(), "left_iri", "left_semi")
    number = allowed.select("left_iri", F.col("value").try_cast("double").alias("number")).where("number is not null")
    keys = [
        (allowed.select("left_iri", F.col("value").alias("iri")), ["left_iri", "iri"]),
        (allowed.select("left_iri", F.col("value").alias("raw")), ["left_iri", "raw"]),
    ]
    rest = reduce(lambda df, k: df.join(k[0], k[1], "left_anti"), keys, listed)
    return rest.withColumn("number", F.col("raw").try_cast("double")).join(number, ["left_iri", "number"], "left_anti").drop("number")


def expected_values(values: DataFrame, cap: int = 8) -> DataFrame:
    """left_iri, values (the first ``cap`` in order), total (null if none is left out)."""
    grouped = values.groupBy("left_iri").agg(F.sort_array(F.collect_list(F.struct("ix", "value"))).alias("all"))
    n = F.size("all")
    return grouped.select("left_iri", F.slice(F.transform("all", lambda x: x["value"]), 1, cap).alias("values"), F.when(n > cap, n).alias("total"))


def expected_of(hints: DataFrame, operators: DataFrame, values: DataFrame, units: DataFrame, cap: int = 8) -> DataFrame:
    """left_iri and what its hints allow: operators, values (the first ``cap``), valuesTotal (if more), units, datatype, shut."""

    def listed(df: DataFrame, col: str, name: str) -> DataFrame:
        order = F.col("ix") if "ix" in df.columns else F.lit(0)
        return df.groupBy("left_iri").agg(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("ix"), F.col(col).alias("x")))), lambda s: s["x"]).alias(name))

    out = hints.select("left_iri", "datatype", F.coalesce("closed", F.lit(False)).alias("shut"))
    every = values.select("left_iri").unionByName(operators.select("left_iri")).unionByName(units.select("left_iri")).distinct()
    out = every.join(out, "left_iri", "full")
    for df, col, name in ((operators, "op", "operators"), (values, "value", "values"), (units, "unit", "units")):
        out = out.join(listed(df, col, name), "left_iri", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    n = F.size("values")
    return out.select("left_iri", "operators", F.slice("values", 1, cap).alias("values"), F.when(n > cap, n).alias("valuesTotal"), "units", "datatype", F.coalesce("shut", F.lit(False)).alias("shut"))
