"""Four layers of hints against plain objects, and the rules that read them."""

import random

from clausework.operators import hints, layers

FACETS = ["operators", "values", "literals", "units", "datatype", "lexical"]
SCHEMA = f"left_iri string, operators {layers.NONE}, values {layers.NONE}, literals {layers.NONE}, units {layers.NONE}, datatype string, lexical {layers.LEXICAL}, closed boolean, values_exact boolean, plural boolean"


def empty():
    return {"operators": [], "values": [], "literals": [], "units": [], "datatype": None, "lexical": None, "closed": False, "values_only": False, "values_exact": False, "plural": False, "src": {}}


def has_values(p):
    return bool(p["values"] or p["literals"])


def take(out, patch, source, *names):
    for n in names:
        if n == "values":
            if has_values(patch):
                out |= {"values": patch["values"], "literals": [] if source == "host" else patch["literals"], "values_exact": source == "host" or patch["values_exact"]}
                out["src"]["values"] = source
        elif patch[n]:
            out[n] = patch[n]
            out["src"][n] = source
    return out


def close(base, patch, source):
    """A closing patch over a base, one case after another."""
    out = base | {"src": dict(base["src"])}
    given = has_values(patch) or any(patch[n] for n in ("operators", "units", "datatype", "lexical"))
    if not given:
        return out
    if source != "overlay" and has_values(patch) and not any(patch[n] for n in ("operators", "units", "datatype", "lexical")):
        if not base["closed"] and (base["operators"] or base["units"] or base["datatype"]):
            out["values_only"] = True
    else:
        if not (base["closed"] and not base["values_only"]):
            out |= {"operators": [], "units": [], "datatype": None}
            if not base["closed"]:
                out |= {"values": [], "literals": []}
        out["values_only"] = False
    return take(out, patch, source, "operators", "values", "units", "datatype", "lexical") | {"closed": True}


def plain(base, overlay, shapes, host):
    out = empty() | {k: v for k, v in base.items()}
    out["src"] = {n: "profile" for n in ("operators", "units", "datatype", "lexical") if base[n]} | ({"values": "profile"} if has_values(base) else {})
    if overlay:
        plural = out["plural"] or overlay["plural"]
        out = close(out, overlay, "overlay") | {"closed": True} if overlay["closed"] else take(out | {"src": dict(out["src"])}, overlay, "overlay", "operators", "values", "units", "datatype")
        out["plural"] = plural
    if shapes:
        out = close(out, shapes, "shapes")
    if host and has_values(host):
        only = empty() | {"values": host["values"], "literals": host["literals"]}
        if host["closed"] and not out["closed"]:
            out = take(out | {"src": dict(out["src"])}, only, "host", "values") | {"closed": True, "values_only": True}
        elif host["closed"]:
            out = close(out, only, "host")
            out |= {"literals": [], "values_exact": True}
        elif not out["closed"]:
            out = take(out | {"src": dict(out["src"])}, only, "host", "values")
    return out


def patch_of(rng, host=False):
    some = lambda *names: [n for n in names if rng.random() < 0.4]
    tag = f"{rng.random():.3f}"
    out = empty() | {"values": some("v" + tag, "w"), "closed": rng.random() < 0.5, "values_exact": not host and rng.random() < 0.3, "plural": rng.random() < 0.2}
    if not host:
        out |= {"operators": some("eq", "lt" + tag), "literals": some("l" + tag), "units": some("u" + tag), "datatype": rng.choice([None, None, "d" + tag]), "lexical": rng.choice([None, None, {"pattern": "p" + tag, "flags": "i", "low": None, "high": None}, {"pattern": None, "flags": None, "low": "1", "high": None}])}
    return out


def test_layers(spark):
    rng = random.Random(6)
    cases = {}
    for k in range(400):
        base = patch_of(rng)
        rest = [patch_of(rng, host=i == 2) if rng.random() < 0.6 else None for i in range(3)]
        if rest[0]:
            rest[0]["lexical"] = None  # an overlay says nothing of forms
            rest[0]["literals"] = []
        cases[f"L{k}"] = (base, *rest)
    table = lambda i: spark.createDataFrame([(k, *[c[i][n] for n in FACETS], c[i]["closed"], c[i]["values_exact"], c[i]["plural"]) for k, c in cases.items() if c[i]], SCHEMA)
    got = {r.left_iri: r.asDict(recursive=True) for r in layers.layered(*[table(i) for i in range(4)]).collect()}
    for k, c in cases.items():
        want = plain(*c)
        r = got[k]
        for n in (*FACETS, "closed", "values_only", "values_exact", "plural"):
            assert r[n] == want[n], (k, n, r, want, c)
        assert {n: r[f"src_{n}"] for n in ("operators", "values", "units", "datatype", "lexical") if r[f"src_{n}"]} == want["src"], (k, c)


def test_patches_of_operands_that_no_profile_hints_at(spark):
    none = spark.createDataFrame([], SCHEMA)
    host = spark.createDataFrame([("urn:h", ["urn:v"], True)], f"left_iri string, values {layers.NONE}, closed boolean")
    r = layers.layered(none, host=host).first()
    assert (r.left_iri, r["values"], r.closed, r.values_only, r.src_values, r.operators) == ("urn:h", ["urn:v"], True, True, "host", [])


def test_rules_read_layers(spark):
    """A profile suggests operators and values, a host closes the values: another value is an error, another operator a suggestion."""
    base = spark.createDataFrame([("L", ["eq"], ["urn:a", "urn:b"])], f"left_iri string, operators {layers.NONE}, values {layers.NONE}")
    host = spark.createDataFrame([("L", ["urn:a"], True)], f"left_iri string, values {layers.NONE}, closed boolean")
    row = spark.createDataFrame(
        [(1, 0, "p", "L", "neq", "iri", "urn:b", "urn:b", "urn:b", None, None)],
        "doc_id int, policy_ix int, path string, left_iri string, operator_name string, right_kind string, raw string, value_any string, value_iri string, unit_iri string, datatype string",
    )
    gaps = row.select("doc_id", "policy_ix")  # the host's list is exact, so a profile that is not loaded holds nothing back
    for closing, want in ((None, {("prose.operator-not-allowed", False)}), (host, {("prose.operator-not-allowed", False), ("prose.value-not-allowed", True)})):
        got = hints.hint_findings(row, *layers.hint_tables(layers.layered(base, host=closing)), gaps).collect()
        assert {(r.rule, r.closed) for r in got} == want
