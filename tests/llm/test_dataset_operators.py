"""Shards, manifest and conversation repair against plain versions, with nulls, repeats, ties, long and empty input."""

import hashlib
import heapq
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from exposura.llm import conversations, manifest, sharding

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, count=300):
    rows = [
        (i, f"Text {i} É数 " * (i % 5), ("en", None, "fr")[i % 3], "hot" if i % 3 else f"s{i % 40}", i % 7 if i % 11 else None)
        for i in range(count)
    ]
    rows += [(5, "other", "en", "hot", 1), (5, "other", "en", "hot", 1), (None, None, None, None, None), (None, "", "", "", 0)]
    rows += [(7000, "x" * 300_000, "en", None, 3), (-4, "Neg", "en", "hot", 3)] + [(9000, "same", "en", "hot", 4)] * 40
    return rows, spark.createDataFrame(rows, DOCUMENTS).repartition(7)


def clashing(df):
    names = ("shard", "slot", "size", "law", "tree", "pos", "leaf", "root", "segment", "place", "letters", "piece", "digest", "_row", "kept")
    return df.withColumns({n: F.lit("other") for n in names})


# --- shards


def plain_shard(key, weights):
    def draw(shard):
        u = (int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        return -math.log(u) / weights[shard]

    return min(range(len(weights)), key=lambda s: (draw(s), s))


@pytest.mark.parametrize("slice_rows", [10_000, 8])
def test_shards(spark, monkeypatch, slice_rows):
    monkeypatch.setattr("exposura.llm.ordering.with_place.__defaults__", (slice_rows,))
    rows, docs = documents(spark)
    got = sharding.shard_documents(clashing(docs), [1.0] * 16).collect()
    expected, slots = [], defaultdict(list)
    for doc, text, *_ in rows:
        data, key = (text or "").encode(), "null" if doc is None else doc
        one = (doc, len(data) + 1, zlib.crc32(data), plain_shard(key, [1] * 16), plain_shard(key, [1] * 17))
        expected.append(one)
        slots[one[3]].append(((doc is not None, doc or 0), one[2], one[1]))
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == Counter(expected)
    assert {r.law for r in got} == {"key"} and all(r.grown_shard in (r.shard, 16) for r in got)
    for shard, order in slots.items():
        placed = sorted((r.slot, ((r.doc_id is not None, r.doc_id or 0), r.text_crc32, r.size)) for r in got if r.shard == shard)
        assert placed == list(enumerate(sorted(order)))


def test_shares_follow_weights_and_only_the_new_shard_gains(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    weights = [1.0, 2.0, 5.0]
    shares = {r.shard: r["count"] / 20_000 for r in sharding.assign_shards(ids, ["doc_id"], weights).groupBy("shard").count().collect()}
    assert all(abs(shares[s] - w / 8) < 0.015 for s, w in enumerate(weights))
    moved = sharding.moves(ids, ["doc_id"], weights, [*weights, 2.0]).where("shard_before != shard_after").collect()
    assert {r.shard_after for r in moved} == {3} and abs(sum(r.rows for r in moved) / 20_000 - 0.2) < 0.015
    some = ids.limit(200).collect()
    placed = {r.doc_id: r.shard for r in sharding.assign_shards(ids, ["doc_id"], weights).where("doc_id < 200").collect()}
    assert all(placed[r.doc_id] == plain_shard(r.doc_id, weights) for r in some if r.doc_id < 200)


@pytest.mark.parametrize("weights", [[], [1.0, 0.0], [1.0, -1.0], [1.0, float("inf")], [float("nan")]])
def test_wrong_weights(spark, weights):
    with pytest.raises(ValueError):
        sharding.assign_shards(spark.range(1), ["id"], weights)


def test_written_shards_and_empty_tables(spark, tmp_path):
    rows, docs = documents(spark, 60)
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, path, ["doc_id"], [1.0] * 4, parts=3)
    back = spark.read.parquet(path)
    assert Counter(tuple(r) for r in back.select(*docs.columns).collect()) == Counter(rows)
    assert all(r.shard == plain_shard("null" if r.doc_id is None else r.doc_id, [1] * 4) for r in back.collect())
    assert sharding.shard_documents(spark.createDataFrame([], DOCUMENTS), [1.0] * 16).collect() == []


# --- manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, lowered=False):
    doc, text, lang, source, n_chars = row
    if lowered and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n_chars, text)])


def plain_tree(leaves):
    paths, level = [[] for _ in leaves], [(leaf, [i]) for i, leaf in enumerate(leaves)]
    while len(level) > 1:
        above = []
        for at in range(0, len(level), 16):
            run = level[at:at + 16]
            for j, (_, below) in enumerate(run):
                step = ("".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1:]))
                for leaf in below:
                    paths[leaf].append(step)
            above.append((digest(*[d for d, _ in run]), [i for _, below in run for i in below]))
        level = above
    return level[0][0], paths


def plain_manifest(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[3]].append(row)
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = plain_tree([plain_leaf(r) for r in groups[s]])
    root, upper = plain_tree([trees[s][0] for s in sources])
    for s, further in zip(sources, upper):
        for row, path in zip(groups[s], trees[s][1]):
            path, leaf = path + further, plain_leaf(row)
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            folded = plain_leaf(row, True) if tampered else leaf
            for before, after in path:
                folded = digest(before, folded, after)
            yield row[0], leaf, trees[s][0], root, digest(*[b + a for b, a in path]), folded, folded == root


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


@pytest.mark.parametrize("slice_rows,broadcast", [(10_000, 2_000), (9, 0)])
def test_manifest(spark, monkeypatch, slice_rows, broadcast):
    monkeypatch.setattr(manifest, "BROADCAST_NODES", broadcast)
    rows, docs = documents(spark, 600)
    got = Counter(tuple(r) for r in manifest.manifest(clashing(docs), tampered(), slice_rows).collect())
    assert got == Counter(plain_manifest(rows))
    assert 0 < sum(n for r, n in got.items() if not r[-1]) < len(rows) / 2


@pytest.mark.parametrize("count", [1, 2, 16, 17, 257])
def test_manifest_of_one_source(spark, count):
    rows = [(i, f"T{i}", "en", "only", i) for i in range(count)]
    got = Counter(tuple(r) for r in manifest.manifest(spark.createDataFrame(rows, DOCUMENTS), tampered()).collect())
    assert got == Counter(plain_manifest(rows))


def test_manifest_of_many_small_sources_and_of_nothing(spark):
    rows = [(i, f"T{i}", "en", f"s{i % 280}", i) for i in range(300)]
    got = Counter(tuple(r) for r in manifest.manifest(spark.createDataFrame(rows, DOCUMENTS), tampered()).collect())
    assert got == Counter(plain_manifest(rows))
    assert manifest.manifest(spark.createDataFrame([], DOCUMENTS), tampered()).collect() == []


def test_a_changed_row_is_found_whatever_the_column(spark):
    rows, docs = documents(spark, 50)
    assert all(r.verified for r in manifest.manifest(docs).collect())
    leaves = {manifest_row.leaf for manifest_row in manifest.manifest(docs).collect()}
    for column, value in (("lang", F.lit("-")), ("source", F.lit("1:a")), ("n_chars", F.col("n_chars") + 1)):
        changed = docs.where("doc_id = 20").withColumn(column, value)
        assert manifest.manifest(changed).first().leaf not in leaves


# --- conversations

TURNS = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\f\r"


def spaced(value):
    return " " if value is None else str(value)


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        out[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_order(row):
    turn, role, text = row
    return turn is not None, turn or 0, role[:32].encode(), text[:32].encode(), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain_repair(rows, faults):
    """Cheapest and then least audit with its rows, by searching prefixes in order of cost and letters."""
    after = {0: "u", 1: "u", 2: "a", 3: "u"}
    states = {"s": 1, "u": 2, "a": 3}
    heap, cheapest, seen = [(0, "", 0, 0, ())], {}, set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, out
        if (cost, audit) in seen or cheapest.setdefault((i, state), cost) < cost:
            continue
        seen.add((cost, audit))
        changed = {"u": "user", "a": "assistant"}[after[state]]
        if i < len(rows):
            _, role, text = rows[i]
            extra = 5 if faults[i] == "truncated" else 0
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if faults[i] not in ("blank", "duplicate"):
                if role[:1] and (role[0] == after[state] or (role[0] == "s" and state == 0)):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, states[role[0]], (*out, (role, text))))
                heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, states[after[state]], (*out, (changed, text))))
        heapq.heappush(heap, (cost + 5, audit + "I", i, states[after[state]], (*out, (changed, ""))))


def plain_audits(damaged):
    for conv, rows in damaged.items():
        rows, seen, faults = sorted(rows, key=plain_order), set(), []
        turns = [t for t, _, _ in rows if t is not None]
        for _, role, text in rows:
            body = text.strip(WHITE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, out = plain_repair(rows, faults)
        yield (
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), illegal, cost, audit, digest("\n".join(f"{r}:{t}" for r, t in out)),
        )


def turns(count=120):
    import random

    rng, rows = random.Random(3), []
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "s", "unknown"]
    texts = ["Yes.", "No!", "Why?", "so on", "", " \n\t", None, "Ends. \r\n", "É数.", "\xa0", "ok…"]
    for conv in range(count):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn * rng.choice((1, 1, 1, 3)), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"T {turn}."))
    rows += [(None, t, "user", f"of nobody {t}.") for t in range(4)] + [(500, None, "user", "no turn."), (500, None, "assistant", "nor here")]
    rows += [(501, 2, "user", "again.")] * 6 + [(502, 1, "user", "long " * 60_000), (502, 2, "assistant", "end.")]
    rows += [(600, t, ("user", "assistant")[t % 2], f"turn {t} of many.") for t in range(60)]
    return rows


@pytest.mark.parametrize("slice_rows,piece", [(10_000, 4096), (11, 4)])
def test_audits(spark, monkeypatch, slice_rows, piece):
    monkeypatch.setattr(conversations, "PIECE", piece)
    monkeypatch.setattr("exposura.llm.ordering.with_place.__defaults__", (slice_rows,))
    rows = turns()
    damaged = conversations.damage(clashing(spark.createDataFrame(rows, TURNS).repartition(5)))
    got = Counter(tuple(r) for r in conversations.audit_conversations(damaged, slice_rows).collect())
    assert got == Counter(plain_audits(plain_damage(rows)))


def test_repaired_rows_follow_the_grammar_and_give_the_digests(spark):
    rows = turns(40)
    damaged = conversations.damage(spark.createDataFrame(rows, TURNS))
    repaired = defaultdict(list)
    for r in sorted(conversations.repair_conversations(damaged).collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.seq)):
        assert r.seq == len(repaired[r.conv_id])
        repaired[r.conv_id].append((r.role, r.text))
    for r in conversations.audit_conversations(damaged).collect():
        own = repaired[r.conv_id]
        assert r.repaired_sha256 == digest("\n".join(f"{a}:{b}" for a, b in own))
        initials = "".join(a[0] for a, _ in own)
        rest = initials.removeprefix("s")
        assert rest == "ua" * (len(rest) // 2) and (rest or not initials)


def test_undamaged_rows_nothing_lost_and_empty_tables(spark):
    good = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes.")]
    out = conversations.audit_conversations(spark.createDataFrame(good, TURNS)).collect()
    assert [tuple(r)[1:8] for r in out] == [(0, 0, 0, 0, 0, 0, "KKK")]
    assert [(r.role, r.text) for r in sorted(conversations.repair_conversations(spark.createDataFrame(good, TURNS)).collect(), key=lambda r: r.seq)] == [r[2:] for r in good]
    empty = spark.createDataFrame([], TURNS)
    assert conversations.audit_conversations(conversations.damage(empty)).collect() == []
    assert conversations.repair_conversations(empty).collect() == []


def test_a_conversation_that_loses_all_rows(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    out = conversations.audit_conversations(conversations.damage(spark.createDataFrame([(lost, 1, "user", "a.")], TURNS))).collect()
    assert [tuple(r) for r in out] == [(lost, 0, 0, 0, 0, 0, 0, "", digest(""))]


def test_each_suffix_is_solved_once(spark):
    letters = ["BCBC", "CBC", "BC", "ABCBC", "BC", "", "FBC", "JBC"]
    signed = spark.createDataFrame([(i, 0, x) for i, x in enumerate(letters)], "conv_id long, gaps long, letters string").coalesce(1)
    planned = conversations.plan_repairs(signed).collect()
    suffixes = {("x" + x[1:] if x[:1] in ("F", "J") else x)[i:] for x in letters for i in range(len(x))}
    assert sum(r.new_nodes for r in planned) == len(suffixes)
    assert {r.conv_id: r.audit for r in planned} == {0: "KKKK", 1: "DKK", 2: "KK", 3: "KKKKK", 4: "KK", 5: "", 6: "DKK", 7: "DKK"}
