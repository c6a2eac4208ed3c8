"""URL filters, prefix trie and spelling variants against brute force, and their case rules."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import prefix_trie, spelling, url_filters
from tessera.llm.queries import RULES

# ---- url filters


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


URLS = [None, "", "no scheme", "http://", "http:///x", "http://COM", "http://com/", "https://Example.com/en/1?q#f", "https://www.example.com/en/", "https://a.www.example.com/en/x", "https://notexample.com/en/1",
        "https://example.com/fr/", "https://x.net/es/1", "https://x.net/esp", "http://net/fr/", "http://x.org/en/", "http://.com/", "http://com./", "http://a..net/es/", "http://u:p@example.com:80/en/1", "x://y.com/a://b.net/es/", "http://example.com#/en/", "http://é.example.com/en/é\nü?"]


@pytest.mark.parametrize("partition_bytes", [1 << 20, 64])
def test_url_filters_brute_force(spark, monkeypatch, partition_bytes):
    monkeypatch.setattr(url_filters, "PARTITION_BYTES", partition_bytes)
    rnd = random.Random(3)
    labels = ["a", "b", "www", "x-y", "0", "é"]
    hosts = [".".join([*rnd.choices(labels, k=rnd.randint(0, 3)), rnd.choice(["com", "net", "org"])]) for _ in range(60)]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/é/"]
    rules = [*RULES, *{(h, rnd.choice(paths)): (h, p, rnd.choice(["allow", "block"])) for h in hosts[:30] for p in rnd.choices(paths, k=2)}.values()]
    urls = URLS + [f"{rnd.choice(['http', 'https'])}://{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', '?x=/a', '#/b', 'z'])}" for _ in range(400)] + ["https://www.example.com/en/hot"] * 300
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, Host string")
    got = url_filters.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    best = {}  # of rules with the same host and path, block wins
    for h, p, v in rules:
        best[h, p] = "block" if "block" in (v, best.get((h, p))) else v
    plain = [(h, p, v) for (h, p), v in best.items()]
    assert found == {i: judged(u, plain) for i, u in enumerate(urls)}


def test_url_filters_spread_a_hot_url(spark):
    """A key that fills several partitions is dealt over all of them."""
    keys = [b"a"] * 10 + [b"m"] * 80 + [b"z"] * 10
    splits = url_filters.splitters(keys, 10)
    assert splits.count(b"m") >= 7 and splits == sorted(splits)


def test_url_filters_cases(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", None), (None, "/", "block"), ("net", None, "block"), ("ORG", "/", "block"), ("org", "/", "allow")], "host string, path string, verdict string")
    assert url_filters.judge(none, rules).count() == 0
    pages = spark.createDataFrame([(None, "http://a.com/"), (None, "http://a.com/"), (1, "http://a.net/"), (2, "http://org/x")], "page_id long, url string")
    assert sorted((r.page_id or 0, r.rule, r.verdict) for r in url_filters.judge(pages, rules, default="none").collect()) == [(0, "com/", "block"), (0, "com/", "block"), (1, None, "none"), (2, "org/", "block")]
    assert {r.verdict for r in url_filters.judge(pages, rules.limit(0)).collect()} == {"allow"}
    long = spark.createDataFrame([(1, "http://a.com/" + "x" * 2_000_000)], "page_id long, url string")
    assert url_filters.judge(long, rules).first().rule == "com/"


# ---- prefix trie


def rebuilt(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            convs[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    turns = {c: [x[2] for x in sorted(t)] for c, t in convs.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - int(np.fmod(c, 5)), [])[:h] + own[h:]
    return out


def brute_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    nodes = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(path))
        nodes.append((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(nodes, key=str)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def spark_trie(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, path string")
    return sorted(((tuple(r[n] for n in NAMES)) for r in prefix_trie.trie(prefix_trie.graft(prefix_trie.sequences(df))).collect()), key=str)


def talk():
    rnd = random.Random(8)
    hot = [("user", "hello"), ("assistant", "ça va"), ("user", "x"), ("assistant", "")]
    rows = []
    for c in [*range(-12, 150), 10**12, 10**12 + 1]:
        turns = hot[: rnd.randint(1, 4)] + [(rnd.choice(["user", None]), rnd.choice(["a", "b", None, "é" * 3])) for _ in range(rnd.choice([0, 0, 1, 2, 9]))] if rnd.random() < 0.7 else [("user", str(c))] * rnd.randint(1, 12)
        rows += [(c, i if rnd.random() < 0.95 else None, *t) for i, t in enumerate(turns)]
    rows += [(None, 0, "user", "lost"), (7, 0, "user", "again"), (7, 0, "user", "again")] + [(77, i, "user", f"turn {i % 3}") for i in range(1500)]
    return rows


@pytest.mark.parametrize("size", [None, 900, 150])
def test_trie_brute_force(spark, monkeypatch, size):
    """Whole, and over many partitions, runs and sweeps of open nodes."""
    if size:
        monkeypatch.setattr(prefix_trie, "PARTITION_BYTES", size)
        monkeypatch.setattr(prefix_trie, "RUN_BYTES", size * 2)
        monkeypatch.setattr(prefix_trie, "FAN", 3)
    rows = talk()
    want = brute_trie({c: t[:60] for c, t in rebuilt([r for r in rows if r[0] != 77]).items()})
    assert spark_trie(spark, [r for r in rows if r[0] != 77]) == want


def test_trie_long_conversation_and_empty_table(spark):
    """One path of many turns: every node but the last has one child."""
    rows = [(77, i, "user", f"turn {i % 3}") for i in range(1500)]
    long = 1500 - zlib.crc32(b"77") % 9
    got = sorted(spark_trie(spark, rows), key=lambda n: n[1])
    assert [n[:7] for n in got] == [(77, d, 77 if d else None, 1, int(d < long), 1, 0) for d in range(long + 1)]
    assert spark_trie(spark, []) == []


def test_trie_turnless_conversation_ends_at_the_root(spark):
    """Conversation 6 has one turn, which its first h replace by those of conversation 5, which isn't there."""
    c = next(c for c in range(6, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    assert spark_trie(spark, [(c, 0, "user", "x")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_loser_tree_merges_without_comparing_shared_turns_again():
    rnd = random.Random(4)
    turn = lambda i: i.to_bytes(prefix_trie.TURN, "big")
    shared = b"".join(turn(9) for _ in range(200))
    rows = [(shared + b"".join(turn(rnd.randint(0, 3)) for _ in range(rnd.randint(0, 5))), c) for c in range(600)]
    rnd.shuffle(rows)
    runs = []
    for i in range(0, 600, 50):
        runs += [run for _, run in prefix_trie.sorted_run([(k, c, np.ones(len(k) // prefix_trie.TURN, np.int64).tobytes()) for k, c in rows[i : i + 50]], [])]
    tree = prefix_trie.LoserTree(runs)
    got = []
    before = []
    for head in tree:
        n = next((i for i, (a, b) in enumerate(zip(before, head.path)) if a != b), min(len(before), len(head.path)))
        assert head.lcp == n
        before = list(head.path)
        got.append((b"".join(head.path), head.ids.tolist()))
    flat = sorted(((k, c) for k, ids in got for c in ids))
    assert flat == sorted(rows) and [k for k, _ in got] == sorted(k for k, _ in got)
    # The 200 shared turns are compared once a run, when the tree is built; all else are the few behind them.
    assert tree.compared < 200 * len(runs) + 600 * 12


# ---- spelling


def brute_variants(rows):
    import re

    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]

    links = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, own in links.items():
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(links[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def spelled():
    rnd = random.Random(6)
    base = ["kitten", "naïveté", "received", "aaaaaaa", "letter", "abcdef", "défcabe", "mississippi", "l" * 70, "ab" * 40, "x" * 64, "x" * 65]
    words = set(base)
    for w in base:
        for _ in range(12):
            i = rnd.randrange(len(w))
            words |= {w[:i] + w[i + 1 :], w[:i] + rnd.choice("abtéxl") + w[i:], w[:i] + rnd.choice("abtéxl") + w[i + 1 :], "".join(rnd.sample(w, len(w)))}
    rows = []
    for d, w in enumerate(sorted(words)):
        times = rnd.choice([1, 4, 5, 6, 30, 31, 160, 900])
        rows.append((d if d % 7 else None, " ".join([w, w.upper() if w.isascii() else w] * (times // 2) + [w] * (times % 2))))
    return rows + [(None, None), (3, ""), (4, "1234 ß÷×ßßß Ünïcödé İstanbul"), (5, "longer " * 50_000)] + rows[:3]


def test_spelling_brute_force(spark):
    rows = spelled()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    got = sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect()), key=str)
    assert got == brute_variants(rows)
    assert any(r[2] != r[0] and r[2] != r[1] for r in got)  # a chain of forms
    assert spelling.variants(df.limit(0)).count() == 0


def test_spelling_probes_of_long_words():
    """Rests of long words have the hash that the rest as a word has."""
    rnd = random.Random(2)
    for size in (65, 66, 67, 200):
        word = "".join(rnd.choice("abé") for _ in range(size))
        for i, (key, rest, place) in enumerate(list(spelling.probes(word))[1:]):
            own_key, own_rest, _ = next(spelling.probes(word[:i] + word[i + 1 :]))
            assert (key, rest) == (own_key, own_rest) and place >> 1 == i
    assert len(set(r for _, r, _ in spelling.probes("ab" * 50_000))) == 100_001


def test_ids_are_places_in_order(spark):
    words = spark.createDataFrame([(f"w{i:05d}é", i) for i in range(3000)], "word string, n long").repartition(7)
    got = [(r.id, r.word) for r in spelling.numbered(words).orderBy("id").collect()]
    assert got == [(i, f"w{i:05d}é") for i in range(3000)]
