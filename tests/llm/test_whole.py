"""Cases that operators for training text passed over."""

import itertools
import json
import math
import random
import string
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from codeloom.llm import ann, chat, line_dedup, lm, mixing, near_dedup, quality, secrets, substring
from codeloom.llm.common import Scratch, tuned

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def literals(text):
    return [text[s:e] for k, s, e in secrets.scan(text) if k == "literal"]


@pytest.mark.parametrize("name", ["privateAccess", "signingEncryption", "privateSigning", "api_access"])
def test_secrets_under_names_of_two_weak_parts(name):
    assert literals(f'{name} = "Zk3!pQ9vLm2xT7"') == ["Zk3!pQ9vLm2xT7"]


@pytest.mark.parametrize("name", ["db_pass", "bearer", "credential", "my_token_value"])
def test_secrets_of_two_classes(name):
    rng = random.Random(7)
    for letters in (string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters):
        for _ in range(300):
            value = "".join(rng.sample(letters, 3) + rng.choices(letters, k=13))
            if sum(any(c in x for c in value) for x in (string.ascii_lowercase, string.ascii_uppercase, string.digits)) == 2:
                assert literals(f'{name} = "{value}"') == [value]
    assert not literals(f'{name} = "internationalization"') and not literals(f'{name} = "accessProviderName"') and not literals(f'{name} = "access_provider"')


def message(calls=(), answers=None, **more):
    return json.dumps(({"tool_calls": [{"id": c, "name": "f", "arguments": {}} for c in calls]} if calls else {}) | ({"tool_call_id": answers} if answers else {}) | more)


def test_chat_order_grows_along_chains(spark):
    rows = [(1, 5, message(["c1"])), (1, 3, message(["c2"], "c1")), (1, 4, message((), "c2"))]
    # a longer chain against the turns, a call that answers an unknown one, two calls in a circle and one that answers itself
    rows += [(2, 40 - i, message([f"d{i + 1}"], f"d{i}")) for i in range(21)] + [(2, 1, message((), "d21")), (2, 50, message((), "d21"))]
    rows += [(3, 7, message(["e1"], "e2")), (3, 8, message(["e2"], "e1")), (3, 9, message(["g"], "g")), (3, 2, message((), "e1")), (4, 3, message(["c1"])), (4, 1, message((), "c1"))]
    got = {(r["conv_id"], r["turn"]): (r["order_turn"], r["order_step"]) for r in chat.formatted(spark.createDataFrame([(c, t, "tool", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 5] == (5, 0) and got[1, 3] == (5, 1) and got[1, 4] == (5, 2)
    assert [got[2, 40 - i] for i in range(21)] == [(40, i) for i in range(21)] and got[2, 1] == (40, 21) and got[2, 50] == (50, 0)
    assert got[3, 7] == (8, 1) and got[3, 8] == (8, 0) and got[3, 9] == (9, 1) and got[3, 2] == (7, 1) and got[4, 1] == (3, 1)


def test_chat_keeps_every_field(spark):
    one = {"tool_call_id": "c1", "is_error": True, "content": "x", "gone": None}
    two = {"type": "m", "tool_calls": [{"type": "function", "id": "c1", "function": {"name": "f", "arguments": "{}"}}], "tools": [{"name": "f", "strict": False}]}
    rows = [(1, 1, None, json.dumps(one)), (1, 0, "assistant", json.dumps(two | {"role": "other"}))]
    got = {r["turn"]: r["json"] for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    canonical = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))
    assert got[1] == canonical({k: v for k, v in one.items() if v is not None}) and got[0] == canonical(two | {"role": "assistant"})


def test_near_dedup_of_repeated_doc_ids(spark):
    text = lambda seed, n=60: " ".join(f"w{random.Random(seed).randrange(10**6) + k}" for k in range(n))
    a, b, c = text(1), text(2), text(3)
    rows = [(1, a, 0), (1, b, 1), (1, a, 2), (2, a + " end", 3), (3, b + " end", 4), (4, c, 5), (None, a, 6), (None, text(4), 7), (None, text(4), 8), (5, "", 9), (5, "", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x long")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(docs, 5, 80).collect()), key=str)
    assert got == sorted([(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (4, 4, True), (None, 1, False)] + [(None, None, True)] * 2 + [(5, 5, True)] * 2, key=str)
    kept = near_dedup.near_dedup(docs, 5, 80)
    assert kept.columns == docs.columns
    x = sorted(r["x"] for r in kept.collect())
    assert len(x) == 6 and len({0, 2} & set(x)) == 1 and len({7, 8} & set(x)) == 1 and {1, 5, 9, 10} <= set(x)


def test_limits_follow_the_spread_of_a_source(spark):
    rng = random.Random(3)
    upper = lambda most: " ".join("A" * rng.randint(0, most) + "b" * 8 + str(k) for k in range(60))
    rows = [(i, upper(most), "en", source) for source, most in (("even", 1), ("wild", 8)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counts = quality.sketches(quality.with_features(docs, "q"), "q")
    got = {r["source"]: r for r in quality.limits(counts).collect()}
    assert got["wild"]["upper_most"] - got["even"]["upper_most"] > 500
    values = sorted(10000 * sum(c.isupper() for c in t) // sum(len(x) for x in t.split()) for _, t, _, s in rows if s == "wild")
    cleared = lambda v: v >> max(0, v.bit_length() - 6) << max(0, v.bit_length() - 6)
    high, mid = (cleared(values[math.ceil(p * 200) - 1]) for p in (0.95, 0.5))
    assert got["wild"]["upper_most"] == high + 3 * (high - mid)
    shouting = spark.createDataFrame([(1000, " ".join("ABCDEFGH" + str(k) for k in range(60)), "en", "even")], docs.schema)
    assert {r[0] for r in quality.quality_filter(docs.union(shouting)).select("doc_id").collect()} == set(range(200))


def test_quality_edges(spark):
    schema = "doc_id long, text string, lang string, source string, quality string, limits string, n_words long"
    empty = spark.createDataFrame([], schema)
    assert quality.quality_filter(empty).count() == 0 and quality.quality_filter(empty).columns == empty.columns
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "en", "s", "a", "b", 1)] * 3 + [(None, text, None, None, "a", "b", 1), (2, None, "en", "s", "a", "b", 1), (3, "", None, "s", "a", "b", 1)]
    out = quality.quality_filter(spark.createDataFrame(rows, schema))
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "1", "1", "None"] and out.columns == empty.columns


def test_targets_are_met_whatever_repeats(spark):
    words_ = lambda n: " ".join(["w"] * n)
    rows = [(7, words_(10), "a")] * 200 + [(8, words_(3), "a"), (None, words_(10), "b"), (None, words_(10), "b"), (None, None, "b")] + [(100 + i, words_(10), "c") for i in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for whole in (False, True):
        taken, target = Counter(), {}
        for r in mixing.mix(docs, whole=whole).select("*", F.lit(1)).collect():
            taken[r["target"], r["source_size"]] += r["taken"]
            target[r["target"], r["source_size"]] = r["target"]
            assert r["taken"] <= 2 * r["size"]
        assert all(abs(taken[k] - target[k]) <= (10 if whole else 1) for k in taken) and len(taken) == 3
    kept = Counter(r["source"] for r in mixing.mixed_documents(docs).collect())
    mixed = {r["source"]: r["n"] for r in mixing.mix(docs, whole=True).join(docs.select("doc_id", "source").distinct(), "doc_id").groupBy("source").agg(F.sum(F.expr("taken div greatest(size, 1)")).alias("n")).collect()}
    assert all(kept[s] == n for s, n in mixed.items())


@pytest.mark.parametrize("text", ["token " + "a=a" * 700_000, "secret " + "x:" * 500_000, "token = 'a'" + " + 'b'" * 200_000, "key\n" + "\n".join(f"secret_{i} = n0\nn{i} = n{i + 1}" for i in range(20_000))])
def test_secret_scans_take_linear_time(text):
    begin = time.perf_counter()
    secrets.scan(text)
    assert time.perf_counter() - begin < 20


def test_literals_against_brute_force():
    """Pairs of one line each; every name that reaches a literal over any names counts, and the best one decides."""
    rng = random.Random(11)
    for _ in range(60):
        names = [rng.choice(["password", "api_key", "plain", "token", "db_pass", "user"]) + str(k) for k in range(8)]
        lines, refers, holds = [], {}, {}
        for k, name in enumerate(names):
            if rng.random() < 0.5:
                value = "".join(rng.choices(string.ascii_letters + string.digits, k=rng.choice([6, 14, 20])))
                holds[name] = value
                lines.append(f'{name} = "{value}"')
            else:
                refers[name] = rng.choice(names)
                lines.append(f"{name} = {refers[name]}")
        text = "\n".join(lines)
        want = set()
        for name in names:
            at, seen = name, set()
            while at in refers and at not in seen:
                seen.add(at)
                at = refers[at]
            if at in holds and secrets.name_score(name) * secrets.literal_score(holds[at]) >= secrets.LEAST:
                want.add(holds[at])
        covered = {v for v in want for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 12 and v in m[0]}
        assert want - covered <= set(literals(text)) <= want


def test_secret_scan_edges(spark):
    schema = "doc_id long, text string, spans string, n_hex string"
    assert secrets.scan_secrets(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "password=abcdefghijkl", "x", "y")] * 2 + [(None, None, None, None), (1, "", "", "")]
    got = sorted((str(r["doc_id"]), r["n_assign"], r["spans"]) for r in secrets.scan_secrets(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", 0, "")] + [("1", 1, "assign:0:21")] * 2 + [("None", 0, "")]


def test_arguments_as_text_and_function_objects(spark):
    tools = {"tools": [{"type": "function", "function": {"name": "add", "parameters": {"properties": {"a": {"type": "integer"}}, "required": ["a"]}}}]}
    call = lambda i, args: {"id": i, "type": "function", "function": {"name": "add", "arguments": args}}
    rows = [(1, 0, "system", json.dumps(tools)), (1, 1, "assistant", json.dumps({"tool_calls": [call("c1", '{"a": 1}'), call("c2", {"a": 2}), call("c3", '{"a": "x"}'), call("c4", "not json")]}))]
    got = {r["turn"]: r for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1]["n_calls"], got[1]["n_valid"], got[1]["n_unknown"]) == (4, 2, 0)


def test_random_chains_of_calls_are_in_order(spark):
    """Every result stands behind its call, along whole chains; on circles the defined places hold."""
    rng = random.Random(9)
    rows, parent = [], {}
    for conv in range(12):
        n = rng.randint(2, 14)
        turns = rng.sample(range(100), n)
        for k in range(n):
            up = rng.randrange(k) if k and rng.random() < 0.8 else None
            parent[conv, turns[k]] = None if up is None else (conv, turns[up])
            rows.append((conv, turns[k], "tool", message([f"c{k}"], None if up is None else f"c{up}")))
    rng.shuffle(rows)
    got = {(r["conv_id"], r["turn"]): (r["order_turn"], r["order_step"]) for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}

    def place(x):
        own = (x[1], 0)
        if parent[x] is None:
            return own
        t, k = place(parent[x])
        return max(own, (t, k + 1))

    assert got == {x: place(x) for x in parent} and all(got[p] < got[x] for x, p in parent.items() if p)


@pytest.mark.parametrize("rounds", [0, 1])
def test_scores_against_all_segmentations(spark, rounds):
    """The whole way: fitted weights and scores of every document, with each word's segmentations listed one by one."""
    v = lm.pieces(PIECES)
    rng = random.Random(6)
    listed = ["the", "then", "a", "été", "zq", "ban", "ana"]
    docs = [(i, " ".join(rng.choice(listed) for _ in range(rng.randint(0, 9)))) for i in range(24)]

    def cuts(word):
        s = lm.MARK + word
        for cut in itertools.product((0, 1), repeat=len(s) - 1):
            ends, ids = [j + 1 for j, c in enumerate(cut) if c] + [len(s)], []
            for a, b in zip([0, *ends], ends, strict=False):
                if s[a:b] in v.ids:
                    ids.append(v.ids[s[a:b]])
                elif b == a + 1:
                    ids += [v.bytes[y] for y in s[a:b].encode()]
                else:
                    break
            else:
                yield ids

    def normal(w):
        share = (w / w.sum()) * (1 - lm.FLOOR) + lm.FLOOR / v.usable.sum()
        return np.log(np.where(v.usable | (np.arange(v.size) == v.end), share, 1.0))

    train = [t for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    logs = normal(v.start)
    for _ in range(rounds):
        uses = np.zeros(v.size)
        for word, n in Counter(w for t in train for w in t.split()).items():
            ps = [(math.exp(sum(logs[j] for j in ids)), ids) for ids in cuts(word)]
            total = sum(p for p, _ in ps)
            for p, ids in ps:
                np.add.at(uses, ids, n * p / total)
        uses[v.end] = len(train)
        logs = normal(uses)
    chance = {w: math.log10(sum(math.exp(sum(logs[j] for j in ids)) for ids in cuts(w))) for w in listed}
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    for frequent in (2, 1000):
        got = {r["doc_id"]: r["score"] for r in lm.score(rows, PIECES, rounds=rounds, frequent=frequent).collect()}
        for i, t in docs:
            assert got[i] == pytest.approx(sum(chance[w] for w in t.split()) + logs[v.end] / math.log(10))


def test_frequent_words_are_chosen_by_their_counts(spark):
    rows = [(f"w{i}".encode(), (1 << 20) + i % 3) for i in range(5000)] + [(b"the", 1 << 40), (b"rare", 1)]
    known = spark.createDataFrame(rows, "word binary, d long")
    got = {bytes(r[0]) for r in known.where(lm.often_used(known, 1000)).select("word").collect()}
    assert b"the" in got and b"rare" not in got and 500 < len(got) <= 1000
    assert known.where(lm.often_used(known, 10_000)).count() == 5002


def test_neighbours_of_a_vec_id_with_two_vectors(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (40, [1.0, 0.0]), (1, [5.0, 0.0]), (2, [0.0, 5.0]), (3, [0.5, 0.1])]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.pmod("vec_id", F.lit(20)) == 0, 2).collect()}
    assert got[40, 1] == (1, 5.0) and got[40, 2] == (20, 1.0) and {got[20, 1], got[20, 2]} == {(1, 5.0), (2, 5.0)}


def test_near_groups_are_the_same_in_any_order(spark):
    rng = random.Random(5)
    base = [" ".join(f"t{rng.randrange(500)}" for _ in range(60)) for _ in range(4)]
    rows = []
    for k in range(60):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 2])):
            w[rng.randrange(60)] = f"n{rng.randrange(500)}"
        rows.append((rng.choice([None, *range(25)]), " ".join(w)))
    sets = [frozenset(zip(t.split(), t.split()[1:], strict=False)) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            top[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = sorted(str((i, least.get(find(k)), i == least.get(find(k)))) for k, (i, _) in enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 7):
        got = near_dedup.near_groups(docs.orderBy(F.rand(parts)).repartition(parts), 2, 80).collect()
        assert sorted(str((r["doc_id"], r["component_id"], r["kept"])) for r in got) == want


@pytest.mark.parametrize("spread, rounds", [(2, 3), (4096, 0)])
def test_hot_buckets_are_dealt(spark, monkeypatch, spread, rounds):
    monkeypatch.setattr(near_dedup, "SPREAD", spread)
    monkeypatch.setattr(near_dedup, "ROUNDS", rounds)
    base = [f"t{k}" for k in range(80)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(40)] + [(99, "far " * 3 + " ".join(f"z{k}" for k in range(50)))]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == {i: 0 for i in range(40)} | {99: 99}


def test_common_lines_beyond_the_broadcast(spark):
    rows = [(i % 15 if i % 9 else None, "\n".join([f"line {k}" for k in range(i % 7, 30)] + [f"own {i}"])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = lambda **more: sorted(str(tuple(r["lines"])) for r in line_dedup.line_dedup(docs, 5, "none", **more)[0].select("lines").collect())
    assert told() == told(broadcast_keys=8) == told(broadcast_keys=0)


# substrings


def removed_by_hand(rows, width):
    """Words kept by row; rows of one doc_id are one document whose equal windows at the same start are not repeats of each other."""
    order = lambda i: (i is None, i or 0)
    first, held = {}, [(i, (t or "").split()) for i, t in rows]
    for i, w in held:
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            first[key] = min(first.get(key, (order(i), s)), (order(i), s))
    out = []
    for i, w in held:
        gone = {s + j for s in range(len(w) - width + 1) if first[tuple(w[s : s + width])] != (order(i), s) for j in range(width)}
        out.append((str(i), len(w), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


@pytest.mark.parametrize("letters, width, anchor", [("ab", 4, 2), ("abcd", 5, 3)])
def test_substrings_of_branching_and_circular_texts(spark, letters, width, anchor):
    rng = random.Random(letters)
    texts = [" ".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(40)]
    texts += ["a " * 30, "a b " * 20, "a b c " * 15, None, "", "a", "p q r s t u v w x y z", "q r s t u v w", "o p q r s t u v w x 1", "r s t u v w x y 2"]
    ids = [rng.choice([None, *range(30)]) for _ in texts]
    rows = list(zip(ids, texts, strict=True)) + [(i, t) for i, t in zip(ids[:5], texts, strict=False)]
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width, anchor).select("doc_id", "n_words", "kept").collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == removed_by_hand(rows, width)


def test_passages_compact_to_one_path(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{' '.join(f'{side}{i}_{j}' for j in range(30))} {passage} {' '.join(f'z{i}_{j}' for j in range(30))}") for i, side in enumerate("uvwxy")]
    spans = substring._removed(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(tuned(spark)), 20, 10).collect()
    assert sorted((r["doc_id"], r["span"]["start"], r["span"]["n"]) for r in spans) == [(i, 30, 41) for i in range(1, 5)]
