"""JSON salvage, containment in a table of queries, quantiles by rank selection, and bootstrap intervals."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from actloom.functions import salvage
from actloom.operators.containment import claims_supported, contained
from actloom.plans import intervals
from actloom.plans.quantiles import quantiles


def valid(text):
    def distinct(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def no(name):
        raise ValueError(name)

    try:
        json.loads(text, object_pairs_hook=distinct, parse_constant=no)
    except ValueError:
        return False
    return True


def widest(text, opens, closes):
    begin, end = text.find(opens), text.rfind(closes)
    return text[begin : end + 1] if 0 <= begin < end else None


def brute(reply):
    """The three forms as (reply, object, any), step by step."""
    t = (reply or "").strip()
    fence = re.search(r"```(?:json)?\s*(.*?)```", t, re.S | re.I)
    tries = [fence.group(1).strip() if fence else None, t if t[:1] in ("{", "[") else None, widest(t, "[", "]"), widest(t, "{", "}")]
    first = next((x for x in tries if x and valid(x)), None)
    bare = t.strip("`").strip() if t.startswith("```") else t
    second = widest(bare, "{", "}")
    third = t
    if t.startswith("```") and (m := re.search(r"```(?:json)?\s*([\s\S]*?)\s*```", t)):
        third = m.group(1).strip()
    third = third if valid(third) else widest(third, "{", "}")
    return first, second if second and valid(second) else None, third if third and valid(third) else None


CASES = [
    None, "", "   ", "no json", '{"a": 1}', ' [1, 2] ', '```json\n{"a": [1, {"b": "]}"}]}\n```', "```JSON [1]```", '```\n[1\n``` and {"b": 2}', '{"a": 1} x', "[1, 2]]", '{"a":1}{"b":2}',
    'x {"a": "}"} y', "x [1] y [2] z", '[{"label": "z"}', '{"a": [1, 2', "null", "12", '"s"', "``````", "``` ```", '```x``` {"a": 1}', "{} []", '1}', '1,"b":2', "1]", '{"a":1,"a":2}', "[NaN]", "[1,]", "]1[", "}{",
]


def test_three_forms(spark):
    rng = random.Random(4)
    noise = ["```", "```json", "{", "}", "[", "]", '"', "a", ":", '{"a": 1}', "[2]", "\n", " ", ",", "\\", "1", '{"b": [{}]}']
    cases = CASES + ["".join(rng.choice(noise) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, reply string")
    got = {r.i: tuple(r)[1:] for r in df.select("i", salvage.reply_json(F.col("reply")), salvage.object_json(F.col("reply")), salvage.any_json(F.col("reply"))).collect()}
    for i, reply in enumerate(cases):
        assert got[i] == brute(reply), reply


def test_first_value():
    rng = random.Random(9)
    noise = ["{", "}", "[", "]", '"', "a", ":", '{"a": 1}', "[2]", " ", ",", "\\", "1", '"k": ', "null", '\\"']
    for _ in range(6000):
        text = "".join(rng.choice(noise) for _ in range(rng.randint(0, 12)))
        spans = [(b, e) for b in range(len(text)) for e in range(b + 1, len(text) + 1) if text[b] in "[{" and _plain(text[b:e])]
        assert salvage.first_span(text) == (min(spans) if spans else None), text


def _plain(text):
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def test_first_value_is_linear():
    import time

    for text in ("[" * 200_000, "[" * 100_000 + "]" * 100_000, '["' * 100_000, "[1," * 50_000 + "x" + "]" * 50_000, '{"a": ' * 30_000 + "1" + "}" * 30_000, '"[' * 100_000):
        began = time.time()
        salvage.first_span(text)
        assert time.time() - began < 10


def test_label_pick(spark):
    cases = {'{"x": 1}': '{"x":1}', '[1, {"z": 1}, {"label": null}, {"label": "b"}]': '{"label":null}', '[{"action": "reuse", "reuse_id": 3}]': '{"action":"reuse","reuse_id":3}', "[]": None, "3": None, "[[{\"label\": 1}]]": None}
    df = spark.createDataFrame([(k,) for k in cases], "reply string")
    got = {r.reply: r.x for r in df.select("reply", F.to_json(salvage.label_payload(salvage.variant(F.col("reply")))).alias("x")).collect()}
    assert got == cases


@pytest.mark.parametrize("size", [16 << 20, 150])
def test_containment(spark, size):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("abC É") for _ in range(rng.randint(0, 40)))) for i in range(80)] + [(None, None), (None, "ABC"), (None, "ABC")]
    queries = [("".join(rng.choice("abcé ") for _ in range(rng.randint(1, 4))),) for _ in range(40)] + [("",), (None,), ("AB",)]
    got = contained(spark.createDataFrame(texts, "i int, text string"), spark.createDataFrame(queries, "query string"), ["i"], shard_bytes=size).collect()
    want = [(i, q) for i, t in texts if t for q in {q.lower() for (q,) in queries if q} if q in t.lower()]
    assert sorted(((r.i, r.query) for r in got), key=repr) == sorted(want, key=repr)
    assert contained(spark.createDataFrame(texts, "i int, text string"), spark.createDataFrame([], "query string"), ["i"]).collect() == []


def test_claims(spark):
    texts = spark.createDataFrame([(1, "The net beats the baseline."), (2, "Nothing")], "doc int, text string")
    claims = spark.createDataFrame([("a", "BEATS"), ("a", "net"), ("b", "net"), ("b", "x"), ("c", "y")], "claim string, query string")
    assert sorted((r.doc, r.claim, r.matched) for r in claims_supported(texts, claims, ["doc"]).collect()) == [(1, "a", ["beats", "net"]), (1, "b", ["net"])]


def test_quantiles_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot", float(rng.choice([7, rng.randint(0, 5000)]))) for _ in range(6000)] + [(f"g{i % 40}", rng.gauss(0, 1)) for i in range(900)] + [("one", 3.0), (None, 1.0), (None, 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = quantiles(df, ["g"], "v", {"a": 0.0, "p25": 0.25, "m": 0.5, "z": 1.0})
        got = {r.g: tuple(r)[1:] for r in out.collect()}
        plan = out._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups) and "percentile" not in plan
    for g, values in groups.items():
        assert got[g] == pytest.approx(np.quantile(values, [0, 0.25, 0.5, 1]).tolist())
    whole = quantiles(df, [], "v", {"m": 0.5}).collect()
    assert whole[0].m == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).collect() == []


def test_intervals(spark):
    rng = random.Random(3)
    rows = [(f"f{g}", float(rng.random() < 0.2 + 0.6 * (g % 2)), g) for g in range(60) for _ in range(rng.randint(1, 30))]
    df = spark.createDataFrame(rows, "g string, hit double, n int")
    terms = {"rate": (F.col("hit"), F.lit(1)), "none": (F.col("hit"), F.lit(0))}
    a = {r.metric: tuple(r)[1:] for r in intervals.ratio_intervals(df.repartition(7), F.col("g"), terms).collect()}
    assert a == {r.metric: tuple(r)[1:] for r in intervals.ratio_intervals(df.repartition(2), F.col("g"), terms).collect()}
    value, low, high, groups = a["rate"]
    assert groups == 60 and low < value < high and a["none"][:3] == (None, None, None)
    # as wide as drawing groups with replacement makes it
    sums = {}
    for g, hit, _ in rows:
        s = sums.setdefault(g, [0, 0])
        s[0] += hit
        s[1] += 1
    drawn = np.random.default_rng(0).choice(np.array(list(sums.values())), (4000, 60)).sum(axis=1)
    want = np.quantile(drawn[:, 0] / drawn[:, 1], [0.025, 0.975])
    assert abs(low - want[0]) < 0.03 and abs(high - want[1]) < 0.03


def test_poisson_weights():
    w = np.concatenate([intervals.group_weights(f"g{i}", 1000, 42) for i in range(200)])
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
