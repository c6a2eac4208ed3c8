"""Functions on small hand-made rows, one for each trap that their meaning has."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import logs, messages, modules, rewrite, scores, text
from tessera.operators import dedup, generators, near_links, ranking, retrieval, sampling, verify
from tessera.plans import corpus


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v if not isinstance(v, (str, int, float, bool)) else F.lit(v))
    return df.select(column.alias("x")).first()[0]


def test_content_id_ignores_outer_space_of_any_kind(spark):
    a, b = one(spark, text.content_id(F.col("t")), t="\n  word  "), one(spark, text.content_id(F.col("t")), t="word")
    assert a == b and len(a) == 64


def test_tokens_of_blank_text(spark):
    assert one(spark, text.tokens(F.col("t")), t="  \n ") == []
    assert one(spark, text.tokens(F.col("t")), t="Été  nu") == ["été", "nu"]


def test_stop_words_before_case_is_folded(spark):
    assert one(spark, text.search_terms(F.col("t")), t="The the MODULE module x ab") == ["the", "module", "ab"]


def test_halves_round_to_even(spark):
    # A raw score of 5 gives 2, as 2.5 rounds to even.
    spec = "---- MODULE A ----\n\\* c\nTypeOK == x\nx' = 1\n\\E y"
    q = one(spark, scores.quality(F.col("t")), t=spec)
    assert (q.raw_score, q.overall) == (5, 2)


@pytest.mark.parametrize("k,n", [(0, 0), (0, 5), (5, 5), (1, 30)])
def test_wilson(spark, k, n):
    ci = one(spark, scores.wilson(F.lit(k), F.lit(n)))
    assert 0 <= ci.low <= (k / n if n else 0) <= ci.high <= 1
    if (k, n) == (1, 30):
        assert math.isclose(ci.low, 0.0059, abs_tol=1e-3) and math.isclose(ci.high, 0.1667, abs_tol=1e-3)


@pytest.mark.parametrize("before,after,reward", [(0.5, 0.495, 0.15), (0.5, 0.48, 0.08), (0.5, 0.505, 0.15), (0.05, 0.5, 0.2 + 0.45 * 0.6 + 0.2), (0.0, 1.0, 1.0)])
def test_reward_bands(spark, before, after, reward):
    assert math.isclose(one(spark, scores.shaped_reward(F.lit(before), F.lit(after))), reward, abs_tol=1e-9)


def test_diamond_ranks_over_gold(spark):
    assert one(spark, scores.rank_of(F.lit("diamond"))) > one(spark, scores.rank_of(F.lit("gold"))) > one(spark, scores.rank_of(F.lit("?")))


def chat(*rows):
    return F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).cast("string").alias("channel"), F.lit(t).alias("content")) for r, c, t in rows])


def test_two_finals_and_no_channel(spark):
    m = chat(("user", None, "u1"), ("assistant", "final", "f1"), ("user", None, "u2"), ("assistant", "final", "f2"), ("assistant", None, "last"))
    assert one(spark, messages.first_final(m)) == "f1" and one(spark, messages.last_final(m)) == "f2" and one(spark, messages.last_user(m)) == "u2"
    assert one(spark, messages.final_or_last(chat(("user", None, "u"), ("assistant", None, "a"), ("assistant", None, "b")))) == "b"
    assert one(spark, messages.first_final(chat(("user", None, "u")))) == ""


def test_standard_roles_merge(spark):
    m = chat(("developer", None, "d"), ("user", None, "u"), ("assistant", "analysis", "a"), ("assistant", "final", "f"))
    assert [(x.role, x.content) for x in one(spark, messages.standard_roles(m))] == [("system", "d"), ("user", "u"), ("assistant", "<analysis>\na\n</analysis>\nf")]


def test_normaliser(spark):
    raw = "<think>no</think>\n```tla\n---- MODULE A ----\nx ∈ y; `b`\n\\* keep; this\nEND\n---- MODULE B ----\n\n\n\n```"
    r = one(spark, rewrite.normalised(F.col("t")), t=raw)
    assert (r.thinks, r.semicolons, r.backticks, r.ends, r.headers, r.operators, r.terminator_added, r.clean) == (1, 1, 2, 1, 1, 1, True, False)
    assert "\\* keep; this" in r.text and "\\in" in r.text and r.text.rstrip().endswith("====") and "MODULE B" not in r.text
    clean = "---- MODULE A ----\nx\n====\n"
    again = one(spark, rewrite.normalised(F.col("t")), t=clean)
    assert again.text == clean and again.clean
    assert one(spark, rewrite.normalised(F.lit(None).cast("string"))).text == ""


def test_shims(spark):
    shim = "---- MODULE MCConsensus ----\nEXTENDS Consensus, TLC\n===="
    assert one(spark, modules.is_shim(F.col("t")), t=shim)
    assert one(spark, modules.is_shim(F.col("t")), t=shim.replace("MCConsensus", "MCKVS").replace("Consensus,", "KeyValueStore,"))
    assert not one(spark, modules.is_shim(F.col("t")), t=shim.replace("MCConsensus", "Consensus2"))
    assert not one(spark, modules.is_shim(F.col("t")), t="no module")


def test_context(spark):
    spec = "---- MODULE A ----\nEXTENDS Naturals, Paxos \\* c\nB == INSTANCE Voting\n===="
    assert one(spark, modules.missing_context(F.col("t")), t=spec) == ["Paxos", "Voting"]
    assert one(spark, modules.missing_context(F.col("t"), F.array(F.lit("Voting"))), t=spec) == ["Paxos"]
    assert one(spark, modules.context_notice(F.col("t")), t="---- MODULE A ----\nEXTENDS Naturals\n====") is None


def test_nested_comments(spark):
    df = spark.createDataFrame([("a (* b (* c *) d *) e (* f",)], "t string")
    assert df.select(modules.block_comments("t")).first()[0] == [" b (* c *) d "]
    assert df.select(modules.without_block_comments("t")).first()[0] == "a  e (* f"


def test_carve_is_whole(spark):
    spec = "---- MODULE A ----\nInit == x\nNext == y\n  /\\ z\nSpec == Init\n====\n"
    c = one(spark, modules.carve(F.col("t")), t=spec)
    assert c.prefix + c.removed + c.suffix == spec and c.removed.startswith("Next ==")


def test_logs_take_the_last_count(spark):
    log = "1 distinct state generated\n12 states generated, 7 distinct states found\nError: Invariant X is violated.\nWarning: UseParallelGC error"
    assert tuple(one(spark, logs.state_counts(F.col("t")), t=log)) == (7, 12)
    assert one(spark, logs.violations(F.col("t")), t=log) == ["Error: Invariant X is violated."]
    p = one(spark, logs.proof_result(F.col("t")), t="All 0 obligations proved.\nAll 3 obligations proved.\n1/2 obligations failed.")
    assert tuple(p) == ("partial", 5, 4, 1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_exact_first_keeps_the_first(spark):
    df = frame(spark, [(3, "a "), (1, "b"), (2, " a"), (4, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in dedup.exact_first(df).collect()) == [1, 2, 4]


def test_online_dedup_is_no_component(spark):
    # A-B and B-C are linked, A-C not: A and C stay.
    words = [str(i) for i in range(41)]
    a, b, c = words[:36], words[2:38], words[5:41]
    df = frame(spark, [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, "")], "doc_id long, text string")
    links = dedup.token_links(df).select("a", "b")
    assert sorted(map(tuple, links.collect())) == [(1, 2), (2, 3)]
    kept = dedup.online_keep(df.select(F.col("doc_id").alias("id")), links, lambda d: d.checkpoint()).filter("kept")
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4]


def test_seed_rows_are_never_returned(spark):
    seed = frame(spark, [(1, "x")], "doc_id long, text string")
    rows = frame(spark, [(1, "x"), (2, " x"), (3, "y"), (4, "y")], "doc_id long, text string")
    assert [r.doc_id for r in dedup.seed_anchored(seed, rows).collect()] == [3]


def in_order(seed, rows):
    """Ids that a filter keeps which reads rows in order after all of the seed, by content and by token sets with Jaccard 0.8."""
    contents, sets, kept = {t.strip() for _, t in seed}, [set(t.lower().split()) for _, t in seed], []
    for i, t in sorted(rows):
        own = set(t.lower().split())
        if t.strip() not in contents and not any(own and len(own & s) / len(own | s) >= 0.8 for s in sets):
            contents.add(t.strip())
            sets.append(own)
            kept.append(i)
    return kept


def test_near_copies_of_the_seed_go(spark):
    rnd = random.Random(4)
    base = [[f"{k}w{i}" for i in range(20)] for k in range(4)]
    texts = [" ".join(w for w in rnd.choice(base) if rnd.random() < 0.9) for _ in range(150)] + ["", " ", "A b", "b a", "lone"]
    ids = rnd.sample(range(1000), len(texts))
    tagged = [(i, t, rnd.random() < 0.1) for i, t in zip(ids, texts, strict=True)]
    seed, rows = ([(i, t) for i, t, s in tagged if s == want] for want in (True, False))
    got = dedup.seed_anchored_near(*(frame(spark, x, "doc_id long, text string") for x in (seed, rows)), lambda d: d.checkpoint())
    want = in_order(seed, rows)
    assert sorted(r.doc_id for r in got.collect()) == want and 0 < len(want) < len(rows)


def test_near_copies_of_the_seed_go_from_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source").collect()]
    seed, rows = ([(i, t) for i, t, s in docs if (s == "src0") == want] for want in (True, False))
    got = corpus.seed_anchored_near_dedup(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in got if not r.from_seed) == in_order(seed, rows)
    first = {}
    for i, t in sorted(seed):
        first.setdefault(t.strip(), i)
    assert sorted(r.doc_id for r in got if r.from_seed) == sorted(first.values())


def test_upsert_only_by_higher_rank(spark):
    old, new = frame(spark, [("a", 2), ("b", 1)], "k string, r int"), frame(spark, [("a", 2), ("b", 3), ("c", 1)], "k string, r int")
    assert sorted(map(tuple, dedup.upsert(old, new, "k", "r").collect())) == [("a", 2), ("b", 3), ("c", 1)]


def test_split_is_a_partition_and_singletons_go_to_eval(spark):
    df = frame(spark, [(i, "a" if i < 30 else "b") for i in range(31)], "id long, s string")
    got = sampling.stratified_split(df, [F.col("s")], "id").groupBy("s", "split").count().collect()
    assert {(r.s, r.split): r["count"] for r in got} == {("a", "eval"): 3, ("a", "train"): 27, ("b", "eval"): 1}


def test_oversample_multiplies(spark):
    assert sampling.oversample(spark.range(3), F.col("id")).count() == 3


def test_batches_number_without_gaps(spark):
    got = sampling.batches(spark.range(37), "id", 10).collect()
    assert all(r.batch_id == r.id // 10 for r in got)


def test_streak_resets(spark):
    df = frame(spark, [(i, v) for i, v in enumerate([0, 0, 1, 0, 0, 0])], "i long, v int").withColumn("k", F.lit(1))
    assert [r.streak for r in ranking.streaks(df, ["k"], "i", F.col("v") == 0).orderBy("i").collect()] == [1, 2, 0, 1, 2, 3]


def test_mutations_change_something(spark):
    df = frame(spark, [(1, "---- MODULE A ----\nInit == x\n====")], "id long, spec string")
    got = generators.mutated(df, "id", "spec", 7).collect()
    assert {r.mutator for r in got} == {"semicolons", "drop_terminator", "fence", "think", "extra_header"} and all(r.broken != r.fixed for r in got)


def test_theorems(spark):
    df = frame(spark, [(1, "---- MODULE A ----\nTHEOREM T == x\n<1>1. QED\n  OBVIOUS\nLEMMA L == y\nBY T\n====")], "id long, spec string")
    got = generators.theorem_chunks(df, "id", "spec").orderBy("place").collect()
    assert [(r.statement, r.proof.split("\n")[0]) for r in got] == [("THEOREM T == x", "<1>1. QED"), ("LEMMA L == y", "BY T")]


def test_checker_hook(spark):
    df = frame(spark, [(1, "good"), (2, "bad")], "id long, spec string")
    checker = lambda texts: [{"valid": t == "good", "tier": "gold" if t == "good" else None} for t in texts]
    assert {r.id: r.valid for r in verify.checked(df, "spec", checker, "id").collect()} == {1: True, 2: False}
    probe = verify.mutation_probe(df, "spec", lambda t: F.replace(t, F.lit("good"), F.lit("worse")), checker, "id").collect()
    assert {r.id: (r.tested, r.caught) for r in probe} == {1: (True, True), 2: (False, False)}


def test_nearest_sets_in_parts(spark, monkeypatch):
    # Ties, copies, sets without a token, and blocks, shards and parts of a few rows give what the token join gives.
    monkeypatch.setattr(retrieval, "CELLS", 20)
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 4)
    rnd = random.Random(6)
    rows = [(i, sorted(set(rnd.choices("abcdefghij", k=rnd.randint(0, 6))))) for i in rnd.sample(range(400), 80)] + [(None, ["a"])]
    sets = frame(spark, rows, "id long, set array<string>")
    want = retrieval.jaccard_neighbours(sets).filter("a % 5 = 0").collect()
    got = retrieval.jaccard_search(sets, sets.filter("id % 5 = 0")).collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def written(spark):
    """Bytes that tasks have shuffled so far."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_links_move_a_set_once_for_many_pairs(spark):
    rnd = random.Random(5)
    words = [f"{rnd.getrandbits(64):x}" for _ in range(1500)]
    texts = [" ".join(w for w in words if rnd.random() < 0.95) for _ in range(60)]
    df = frame(spark, list(enumerate(texts)), "doc_id long, text string").checkpoint()
    before = written(spark)
    assert len(dedup.token_links(df).collect()) == 60 * 59 // 2
    assert written(spark) - before < 2 * sum(map(len, texts))


def test_links_are_those_of_all_pairs(spark, monkeypatch):
    """Small cells and groups, sets of all sizes, frequent words and equal sets, against brute force."""
    monkeypatch.setattr(near_links, "CELL_PAIRS", 4)
    monkeypatch.setattr(near_links, "GROUP_SETS", 3)
    rnd = random.Random(6)
    base = [[rnd.choice(["the", "of", "and", f"w{rnd.randrange(300)}"]) for _ in range(n)] for n in (1, 2, 3, 4, 5, 9, 10, 11, 30, 90)]
    texts = [" ".join(w for w in rnd.choice(base) if rnd.random() < 0.93) for _ in range(300)]
    df = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    first = {}
    for i, t in enumerate(texts):
        if t.split():
            first.setdefault(frozenset(t.split()), i)
    want = {(i, j): len(s & u) / len(s | u) for s, i in first.items() for u, j in first.items() if i < j and len(s & u) / len(s | u) >= 0.8}
    assert {(r.a, r.b): r.jaccard for r in dedup.token_links(df).collect()} == want and len(want) > 100


def test_links_write_no_row_for_each_meeting(spark):
    """Rows of frequent words: most share some, none are alike."""
    rnd = random.Random(7)
    df = frame(spark, [(i, " ".join(rnd.sample([f"w{j}" for j in range(120)], 40))) for i in range(1500)], "doc_id long, text string").checkpoint()
    before = written(spark)
    assert not dedup.token_links(df).collect()
    assert written(spark) - before < 5e5


def test_links_of_small_blocks_are_those_of_all_pairs(spark, monkeypatch):
    """Blocks of a few rows, equal sizes cut by a hash, few meetings at a time; within a table and between two."""
    for name, n in (("BLOCK_ITEMS", 40), ("SMALL_BLOCK", 40), ("STEP", 50)):
        monkeypatch.setattr(near_links, name, n)
    rnd = random.Random(8)
    base = [[f"v{rnd.randrange(60)}" for _ in range(n)] for n in (3, 12, 12, 13, 30, 31, 60)]
    texts = [" ".join(w for w in rnd.choice(base) if rnd.random() < 0.95) for _ in range(160)]
    sets = {i: frozenset(t.split()) for i, t in enumerate(texts) if t}
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
    df = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    first = sorted({s: i for i, s in reversed(sets.items())}.values())
    links = dedup.token_links(df).collect()
    assert sorted((r.a, r.b) for r in links) == [(i, j) for i in first for j in first if i < j and alike(i, j)] and len(links) > 100
    order = near_links.token_order(near_links.token_counts(df))
    halves = [near_links.prefixes(df.filter(f"doc_id % 2 = {k}"), order, 0.8, alone=True).checkpoint() for k in (0, 1)]
    met = near_links.candidates(*halves, 0.8).collect()
    kept = [{r.id for r in h.collect()} for h in halves]
    assert len(set(met)) == len(met) and {(i, j) for i in kept[0] for j in kept[1] if alike(i, j)} <= {(r.a, r.b) for r in met}


def test_links_of_what_is_decided_go(spark):
    """A clique of 400 rows: after the first round nothing is left, and no round shuffles all links again."""
    n = 400
    links = spark.range(n).select(F.col("id").alias("a")).crossJoin(spark.range(n).select(F.col("id").alias("b"))).filter("a < b").checkpoint()
    before, bound = written(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = dedup.online_keep(spark.range(n), links, lambda d: d.checkpoint()).filter("kept").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert [r.id for r in kept] == [0] and written(spark) - before < 2e5
    rnd = random.Random(3)
    pairs = sorted({tuple(sorted(rnd.sample(range(60), 2))) for _ in range(150)})
    want = []
    for i in range(60):
        if not any((a, i) in pairs for a in want):
            want.append(i)
    got = dedup.online_keep(spark.range(60), frame(spark, pairs, "a long, b long"), lambda d: d.checkpoint()).filter("kept").collect()
    assert sorted(r.id for r in got) == want


def test_bands_find_what_signatures_share(spark):
    n = 300
    sets = spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.when(i == 0, F.col("id") % 7).otherwise(i).cast("string")).alias("set"))
    keys = dedup.band_keys(sets, 8, 2).checkpoint()
    links = spark.range(n).select(F.col("id").alias("a")).crossJoin(spark.range(n).select(F.col("id").alias("b"))).filter("a < b").checkpoint()
    own = {r.id: r["keys"] for r in keys.collect()}
    found = dedup.links_found(links, keys).collect()
    assert {(r.a, r.b) for r in found} == {(i, j) for i in range(n) for j in range(i + 1, n) if any(x == y for x, y in zip(own[i], own[j], strict=True))}
