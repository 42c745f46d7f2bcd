import base64
import hashlib
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import bpe, chat, classifier, embeddings, linededup, minhash, mixing, quality_rules, urlfilter, warc
from lexmill.llm.common import components
from lexmill.llm.queries import multi_vocabulary

WORDS = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece".split()


def docs(spark, texts, extra=()):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumns({c: F.lit("x") for c in extra})


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    h = bpe.MinimalPerfectHash(keys)
    assert sorted(h.lookup(keys)) == list(range(5000))
    assert h.lookup([b"none", b""]) == [-1, -1]


def test_bpe_equals_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " \n", "hola <|endoftext|> niño\x1c\x85  x", "a" * 3000, "日本語 🙂" * 50, "don't  12345\r\n\r\n"]
    v = multi_vocabulary()
    out = bpe.decode(bpe.encode(docs(spark, texts, ("ids", "decoded")), v), v).collect()
    for r in out:
        t = texts[r["doc_id"]] or ""
        ids = own.encode_ordinary(t)
        assert (r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) == (len(ids), struct.pack(f"<{len(ids)}I", *ids), t.encode())
    assert bpe.encode(docs(spark, ["a"]).limit(0), v).count() == 0


def test_bpe_query_equals_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    from lexmill.llm.queries import op1_bpe

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op1_bpe(spark, sf).collect():
        ids = own.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_url_rules(spark):
    urls = ["http://A.Example.org/es/x", "http://xexample.org/es/", "http://b.com/de/", "http://b.com/de", None, "nothing", "http://org"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block")], "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(pages, rules).collect()}
    assert got == {0: ("example.org/es/", "block"), 1: ("org/", "allow"), 2: ("com/de/", "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow")}


def test_url_rules_long_and_repeated(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "HEAD", 4)
    monkeypatch.setattr(urlfilter, "LABELS", 2)
    many = ".".join(["a"] * 20_000) + ".org"
    urls = [f"http://{many}/es/long/x", "http://b.c.org/es/long", "http://c.org/es/lo", "http://x.b.c.org/es/longer", "http://x.b.c.org/es/longer", "http://z.c.org/", "http://org/" + "p" * 100_000]
    rules = [("b.c.org", "/es/long", "block"), ("c.org", "/es/", "allow"), ("b.c.org", "/es/longe", "allow"), ("org", "/es/long", "block"), ("org", "/es/", "block"), ("org", "/pppp", "block"), ("org", "/ppppq", "allow")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(pages, table).collect()}
    for i, u in enumerate(urls):
        host, _, path = u.removeprefix("http://").partition("/")
        fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        assert got[i] == ((max(fit)[3], max(fit)[2]) if fit else (None, "allow"))
    assert urlfilter.judge(pages.limit(0), table).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(pages, table.limit(0)).collect()} == {"allow"}


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "c", None])) for i in range(3000)] + [(9999, None, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit(1))
    out = mixing.mix(df)
    again = {tuple(r) for r in mixing.mix(df.repartition(7)).select("doc_id", "taken").collect()}
    assert {tuple(r) for r in out.select("doc_id", "taken").collect()} == again
    assert out.where("taken > 3 * size").count() == 0 and out.count() == len(rows)
    for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= max(45, 0.01 * r["target"])


def plain_mix(rows, cycle=(5.0, 2.0, 1.0), cap=3):
    """source -> (words, target, tilt) by bisection in plain Python; ``rows``: (source, size)."""
    sources = sorted({s for s, _ in rows}, key=lambda s: (s is None, s or ""))
    words = {s: sum(n for x, n in rows if x == s) for s in sources}
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(sources)}
    target, free = {}, set(sources)
    while free:
        left = sum(words.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * words[s]}
        target |= {s: cap * words[s] for s in over} or share
        free -= over or free
    out = {}
    for s in sources:
        low, high = -100.0, 100.0
        for _ in range(200):
            tilt = (low + high) / 2
            got = sum(n * min(cap, np.exp(min(50.0, tilt * n))) for x, n in rows if x == s)
            low, high = (tilt, high) if got < target[s] else (low, tilt)
        out[s] = (words[s], target[s], tilt)
    return out


@pytest.mark.parametrize("sizes", [{"a": 30, "b": 800, "c": 900}, {"a": 5, "b": 9, "c": 2000, None: 1000}, {"a": 400, "b": 0, "c": 300}, {"a": 1}])
def test_mixing_equals_brute_force(spark, sizes):
    rng = random.Random(5)
    rows = [(s, rng.choice([0, 3, 3, 7, rng.randint(1, 60)])) for s, n in sizes.items() for _ in range(n or 4)]
    rows = [(s, n if sizes[s] else 0) for s, n in rows]
    df = spark.createDataFrame([(i, " ".join(["w"] * n), s, -1, "x") for i, (s, n) in enumerate(rows)], "doc_id bigint, text string, source string, size bigint, copies string")
    out = mixing.mix(df).collect()
    want = plain_mix(rows)
    assert len(out) == len(rows)
    for s, (words, target, tilt) in want.items():
        own = [r for r in out if r["source"] == s]
        largest = max(r["size"] for r in own)
        assert all(r["source_size"] == words and abs(r["target"] - target) < 1e-6 * max(target, 1) for r in own)
        # whole copies stray from the target by less than two documents, from a capped source's not at all
        assert abs(sum(r["taken"] for r in own) - target) <= (0 if target == 3 * words else 2 * largest)
        for n in {r["size"] for r in own if r["size"]}:
            same = [r["copies"] for r in own if r["size"] == n]
            assert max(same) - min(same) <= 1 and max(same) <= 3
            # what _settle gives or takes comes on top of the rounding of the tilted rates
            assert abs(sum(same) - len(same) * min(3, np.exp(min(50.0, tilt * n)))) <= 2 + 2 * largest / n
    assert all(r["taken"] == r["copies"] * r["size"] for r in out)


def test_mixing_odd_inputs(spark):
    df = spark.createDataFrame([(1, None, None), (None, " ", "a"), (1, "", "a")], "doc_id bigint, text string, source string")
    assert [(r["size"], r["taken"], r["target"]) for r in mixing.mix(df).collect()] == [(0, 0, 0.0)] * 3
    assert mixing.mix(df.limit(0)).count() == 0
    same = spark.createDataFrame([(7, "a b c d", "a")] * 5 + [(8, "w " * 30, "b")] * 4, "doc_id bigint, text string, source string")
    assert mixing.mix(same).count() == 9


def test_pipeline_mixing_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    ids = [None, None, 7, 7, 7]
    rows = [(k, f"a{i} " * 10, "es", "a", 1) for i, k in enumerate(ids)] + [([None, 7, 100 + i][i % 3], f"b{i} " * 10, "es", "b", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.mix_sources(spark, df, "").collect()
    count = {r: 0 for r in rows}
    for r in out:
        count[tuple(r)] += 1
    # a's share of all 650 words by weight is above 3 times its own 50: each of its rows is taken 3 times, and b's get the other 500
    assert all(count[r] == 3 for r in rows[:5])
    assert max(count.values()) <= 3 and sum(count[r] for r in rows[5:]) == 50
    assert list(out[0].asDict()) == corpus_pipeline.COLUMNS


def test_pipeline_stages_brute_force(spark):
    """Every stage on its predecessor's rows, with nulls, ties, repeated rows and ids, against the plain rules."""
    import corpus_pipeline as P

    rng = random.Random(21)
    line = lambda: " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(12))
    shared = "\n".join(line() for _ in range(6))
    texts = ["\n".join(line() for _ in range(8)) for _ in range(30)]
    texts += [texts[0], texts[1] + "\nextra words", f"{shared}\n{texts[2]}", f"{line()}\n{shared}\n{line()}\n{line()}", None, "", "too short", "a b c " * 60]
    near = " ".join(f"n{i}" for i in range(200))
    texts += [near, near + " more", near.replace("n7 ", "x ")]
    rows = [(i, t, "es", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)] + [(None, line() + "\n" + "\n".join(line() for _ in range(5)), "es", None, 1)]
    docs_ = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = P.apply_quality_rules(spark, docs_.withColumn("kept", F.lit(0)), "")
    short = lambda t: len((t or "").split()) < 50
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()) == sorted(-1 if i is None else i for i, t, *_ in rows if not short(t) and t != "a b c " * 60)
    lines = P.drop_repeated_lines(spark, kept, "")
    got = {r["doc_id"]: r["text"] for r in lines.where("doc_id is not null").collect()}
    ids = sorted(got)
    assert [got[i] for i in ids] == all_pairs_left([texts[i] for i in ids])
    groups = P.drop_near_duplicates(spark, lines, "")
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in got.items()}
    linked = {j for j in ids for i in ids if i < j and shingles[i] and 100 * len(shingles[i] & shingles[j]) >= 80 * len(shingles[i] | shingles[j])}
    assert {len(texts) - 2, len(texts) - 1} <= linked and {r["doc_id"] for r in groups.collect()} == set(ids) - linked | {None}
    mixed = P.mix_sources(spark, groups, "")
    taken = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.mix(groups).collect() if r["copies"]}
    assert {(r["doc_id"], r["source"]): r["n"] for r in mixed.groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect()} == taken
    out = P.encode(spark, mixed, "")
    assert out.count() == mixed.count() and out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    digests = {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in mixed.collect()}
    assert {(r["doc_id"], r["decoded_sha256"]) for r in out.collect()} == digests
    for stage in (P.apply_quality_rules, P.drop_repeated_lines, P.drop_near_duplicates, P.mix_sources, P.encode):
        assert stage(spark, docs_.limit(0), "").count() == 0


def test_line_dedup_keeps_first(spark):
    line = " ".join(WORDS[:6])
    texts = [f"{line}\nown a", f"own b\n{line}\nown c", None, "", f"{line}\n{line}", "own a"]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.dedup(docs(spark, texts)).collect()}
    assert got[0] == (texts[0], 0) and got[1] == ("own b\nown c", 1) and got[2] == (None, 0) and got[3] == ("", 0)
    assert got[4][1] == 1 and got[5] == ("own a", 0)


def all_pairs_left(texts, least=5):
    """What stays when every run of adjacent lines with ``least`` words that any earlier document holds too goes."""
    rows = []
    for t in texts:
        lines = (t or "").split("\n")
        at = [i for i, x in enumerate(lines) if x.strip()]
        rows.append((at, [len(lines[i].split()) for i in at], [lines[i] for i in at]))
    runs = [{tuple(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)} for _, _, x in rows]
    out = []
    for j, (at, sizes, later) in enumerate(rows):
        gone = set()
        for start in range(len(later)):
            for end in range(start + 1, len(later) + 1):
                if sum(sizes[start:end]) >= least and any(tuple(later[start:end]) in r for r in runs[:j]):
                    gone |= {at[k] for k in range(start, end)}
        left = texts[j] and "\n".join(x for i, x in enumerate(texts[j].split("\n")) if i not in gone)
        out.append("" if gone and not left.strip() else left)
    return out


def test_line_dedup_odd_inputs(spark):
    rng = random.Random(9)
    line = [" ".join(f"w{k}" for k in range(i % 7 + 1)) + f" {i}" for i in range(12)]
    texts = ["\n".join(rng.sample(line, rng.randint(0, 7))) for _ in range(60)] + [None, "", "\n \n", line[6] + "\n" + "x\n" * 5000, "x\n" * 5000]
    df = docs(spark, texts, ("n_removed", "gone", "hashes", "at"))
    out = linededup.dedup(df)
    assert out.columns == ["doc_id", "text", "gone", "hashes", "at", "n_removed"]
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert [got[i] for i in range(63)] == all_pairs_left(texts[:63]) and got[64] == ""
    assert linededup.dedup(df.limit(0)).count() == 0
    ends = linededup.dedup(docs(spark, [line[6] + "\n\n", line[6] + "\n\n", "\n\n"])).orderBy("doc_id").collect()
    assert [(r["text"], r["n_removed"]) for r in ends] == [(line[6] + "\n\n", 0), ("", 1), ("\n\n", 0)]
    again = spark.createDataFrame([(1, line[6]), (2, line[6]), (2, line[6]), (None, line[6]), (None, None)], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in linededup.dedup(again).collect() if r["text"] is not None) == [(0, line[6]), (1, line[6]), (2, ""), (2, "")]


def test_line_dedup_with_repeats(spark):
    """Of repeated runs at least as many go as any earlier document holds, and nothing goes that none holds."""
    rng = random.Random(11)
    line = [" ".join(f"w{k}" for k in range(i % 7 + 1)) + f" {i}" for i in range(9)]
    lines = [[rng.choice(line) for _ in range(rng.randint(0, 9))] for _ in range(50)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(docs(spark, ["\n".join(x) for x in lines])).collect()}
    could = all_pairs_left(["\n".join(x) for x in lines])
    for j, own in enumerate(lines):
        left = got[j].split("\n") if got[j] else []
        assert all(left.count(x) >= could[j].split("\n").count(x) for x in line)
        for x in line:
            if len(x.split()) >= 5:
                assert left.count(x) <= max(0, own.count(x) - max([0, *(e.count(x) for e in lines[:j])]))


@pytest.mark.parametrize("hot", [1000, 2])
def test_line_dedup_equals_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(linededup, "LEAST_HOT", hot)
    monkeypatch.setattr(linededup, "HELD_PAIRS", hot)
    short = [f"s{i} t{i}" for i in range(30)]
    long_ = [" ".join(f"l{i}w{k}" for k in range(6)) for i in range(12)]
    passage = "\n".join(short)
    alone = [f"own {i} of document {i} is here\n{x}\nand {i}" for i, x in enumerate(short)]
    other_order = ["\n".join(long_[6:] + long_[:6][::-1]), "\n".join(long_), "\n".join(long_)]
    rng = random.Random(7)
    extra = ["\n".join(f"x{k + n}" for k in range(rng.randint(2, 9))) for n in (0, 3, 0, 5, 3, 1)]
    texts = [*alone, f"C\n{passage}\nc", f"D\n{passage}\nd", *other_order, *extra]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(docs(spark, texts)).collect()}
    want = all_pairs_left(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert want[31] == "D\nd" and want[34] == ""


def test_doomed_equals_shared_runs():
    rng = random.Random(1)
    for _ in range(2000):
        size = [rng.randint(1, 6) for _ in range(12)]
        a, b = (rng.sample(range(12), rng.randint(0, 9)) for _ in range(2))
        spans = lambda x: {(i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1) if sum(size[k] for k in x[i:j]) >= 5}  # noqa: E731, B023
        held = {tuple(a[i:j]) for i, j in spans(a)}
        assert linededup.doomed(a, b, [size[x] for x in b], 5) == sorted({k for i, j in spans(b) if tuple(b[i:j]) in held for k in range(i, j)})


def test_patience_matches_are_a_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 12))] for _ in range(2))
        m = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:]))


def test_chat_paths_and_escapes(spark):
    rows = [(1, 1, None, "user", "</s>[INST] <|end|> [\\/INST]", 0.0), (1, 2, 1, "assistant", "a<|text|>", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 3, "user", None, 0.0), (2, 1, 7, "user", "lost parent", None), (3, 1, 2, "u", "", 0.0), (3, 2, 1, "u", "", 0.0)]
    nodes = spark.createDataFrame(rows, "tree int, node int, parent int, role string, text string, score double")
    out = chat.format_trees(nodes, None).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_mask")))
    got = {(r["tree"], r["leaf"]): ([(t["role"], t["text"]) for t in r["turns"]], r["loss"]) for r in out.collect()}
    assert got == {(1, 2): ([("user", rows[0][4]), ("assistant", "a<|text|>")], "a<|text|>"), (1, 4): ([("user", rows[0][4]), ("assistant", "b"), ("user", "")], "b"), (2, 1): ([("user", "lost parent")], "")}
    assert [r["leaf"] for r in chat.format_trees(nodes, 1).where("tree = 1").collect()] == [4]


def test_chat_ties_chains_and_empty(spark):
    rng = random.Random(13)
    rows = []
    for tree in (1, 2, None):
        for node in range(60):
            parent = None if node == 0 else rng.randrange(max(0, node - 3), node)
            rows.append((tree, node, parent, rng.choice(["user", "assistant"]), rng.choice(["", "a", "<|end|>", "[INST]" * 3]), rng.choice([None, 0.0, 1.0])))
    rows += [(9, k, k - 1 if k else None, "user" if k % 2 == 0 else "assistant", f"t{k}", 0.0) for k in range(300)]
    nodes = spark.createDataFrame(rows, "tree int, node int, parent int, role string, text string, score double").withColumns({"leaf": F.lit(1), "branch": F.lit("x")})
    got = {r["tree"]: r for r in chat.format_trees(nodes).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    for tree in (1, 2, None, 9):
        own = {n: (p, r, t, s or 0.0) for x, n, p, r, t, s in rows if x == tree}
        best = None
        for leaf in sorted(own.keys() - {p for p, *_ in own.values()}):
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = own[at][0]
            if best is None or sum(own[n][3] for n in path) > best[0] + 1e-9:
                best = (sum(own[n][3] for n in path), leaf, [(own[n][1], own[n][2]) for n in path[::-1]])
        assert (got[tree]["score"], got[tree]["leaf"], [tuple(t) for t in got[tree]["turns"]]) == best
    assert chat.format_trees(nodes.limit(0)).count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_minhash_equals_brute_force(spark, width):
    rng = random.Random(width)
    base = [[rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 90))] for _ in range(25)]
    texts = [None, "", " ", "uno"] + [" ".join(w) for w in base for _ in range(2)]
    for w in base:
        for n in (1, 3):
            x = list(w)
            for _ in range(n):
                x[rng.randrange(len(x))] = "changed"
            texts.append(" ".join(x))
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs(spark, texts, ("keys",)), width=width).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_classifier_rejects_junk(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(WORDS) for _ in range(60))
    rows = [(i, good(), "es") for i in range(300)] + [(1000 + i, "#Q%Z " * 40, "es") for i in range(5)] + [(2000, None, "es"), (2001, "", None), (2002, "x", "zz")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("perplexity", F.lit(0))
    out = {r["doc_id"]: r for r in classifier.classify(df, df.where("doc_id < 200").select("doc_id")).collect()}
    assert len(out) == len(rows)
    assert sum(out[i]["kept"] for i in range(300)) >= 295
    assert not any(out[1000 + i]["kept"] for i in range(5))
    assert not out[2000]["kept"] and not out[2001]["kept"] and out[2002]["kept"]


def test_quantiles_are_values_of_a_rank(spark):
    rng = random.Random(8)
    rows = [(g, rng.choice([1.0, 2.0, rng.random() * 50 + 1e-9])) for g in ("a", "b", None) for _ in range(997)] + [("one", 3.0)]
    for q in (0.0, 0.5, 0.995, 1.0):
        got = {r["g"]: r["quantile"] for r in classifier.quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", q).collect()}
        for g in ("a", "b", None, "one"):
            own = sorted(v for h, v in rows if h == g)
            assert got[g] == own[max(1, int(np.ceil(q * len(own)))) - 1]
    assert classifier.quantiles(spark.createDataFrame([], "g string, v double"), "g", "v", 0.5).count() == 0


def test_classifier_thresholds_are_the_stated_ones(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 60))), "es") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = classifier.classify(df, df.select("doc_id")).join(df.select("doc_id", (F.pmod(F.xxhash64("text"), F.lit(10)) == 0).alias("held")), "doc_id").collect()
    assert classifier.ORDER == 5
    assert abs(out[0]["threshold"] - 1.1 * max(r["perplexity"] for r in out if r["held"])) < 1e-9


def test_classifier_rejects_shuffled_words(spark):
    rng = random.Random(6)
    order = [w for w in WORDS if w != "trece"]
    good = lambda n: " ".join(order[(k + n) % 12] for k in range(60))
    texts = [good(rng.randrange(12)) + f"\n{WORDS[i % 7]}" * (i % 5) for i in range(300)]
    mixed = [" ".join(rng.sample(texts[i].split(), len(texts[i].split()))) for i in range(20)]
    df = spark.createDataFrame([(i, t, "es") for i, t in enumerate(texts + mixed)], "doc_id bigint, text string, lang string")
    out = {r["doc_id"]: r for r in classifier.classify(df, df.where("doc_id < 300").select("doc_id")).collect()}
    assert sum(out[i]["kept"] for i in range(300)) >= 295
    assert not any(out[300 + i]["kept"] for i in range(20))
    assert all(out[300 + i]["n_symbols"] == out[i]["n_symbols"] for i in range(20))


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_classifier_grams_equal_slices(monkeypatch, piece):
    monkeypatch.setattr(classifier, "PIECE", piece)
    texts = ["ab  cd\n", "", " \t", "\x00\x02x\x03 ñ🙂", "é", "".join(map(chr, range(300, 20000))), "a\ud800b\x85c"]
    for order in (1, 3, 5):
        got = [[] for _ in texts]
        for group in classifier._pieces(texts, order):
            names, which = classifier._grams([p for _, p in group], order)
            assert len(set(names)) == len(names)
            place = iter(which.tolist())
            for k, p in group:
                got[k] += [names[next(place)] for _ in range(len(p) - order + 1)]
        for t, g in zip(texts, got, strict=True):
            s = "".join(w.decode("utf-8", "surrogatepass") + "\x03" for w in t.encode("utf-8", "surrogatepass").split())
            s = "\x02" * (order - 1) + s if s else ""
            assert g == [s[i : i + order] for i in range(len(s) - order + 1)]


def plain_kneser_ney(train, order):
    """Interpolated modified Kneser-Ney of one language in plain Python: n-gram -> probability of its last symbol."""
    from collections import Counter, defaultdict

    counts = {order: Counter(g for s in train for g in (s[i : i + order] for i in range(len(s) - order + 1)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    by_context, discounts = {}, {}
    for k, own in counts.items():
        by_context[k] = defaultdict(list)
        for g, n in own.items():
            by_context[k][g[:-1]].append(n)
        c = {i: sum(n == i for n in own.values()) for i in (1, 2, 3, 4)}
        if c[1] and c[2]:
            y = c[1] / (c[1] + 2 * c[2])
            own_d = [i - (i + 1) * y * c[i + 1] / c[i] if c[i] else (0.5, 1.0, 1.5)[i - 1] for i in (1, 2, 3)]
            discounts[k] = [max(0.1, min(float(i + 1), d)) for i, d in enumerate(own_d)]
        else:
            discounts[k] = [0.5, 1.0, 1.5]

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        k, lower = len(g), p(g[1:])
        follow = by_context[k].get(g[:-1])
        if not follow:
            return lower
        n, d, total = counts[k].get(g, 0), discounts[k], sum(follow)
        gamma = sum(d[min(x, 3) - 1] for x in follow) / total
        return (n - (d[min(n, 3) - 1] if n else 0)) / total + gamma * lower

    return p


@pytest.mark.parametrize("limits", [(16 << 20, 64 << 20), (300, 100)])
def test_classifier_equals_plain_kneser_ney(spark, monkeypatch, limits):
    monkeypatch.setattr(classifier, "BATCH_CHARS", limits[0])
    monkeypatch.setattr(classifier, "PACK_CHARS", limits[1])
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(WORDS[: 6 + 3 * (i % 3)]) + rng.choice(["", "\n", "ñ", "🙂"]) for _ in range(rng.randint(0, 25))), rng.choice(["es", None])) for i in range(120)]
    rows += [(200, "".join(map(chr, range(0x4E00, 0x6600))) * 2, "es"), (7, rows[7][1], rows[7][2]), (None, "uno dos", "es"), (201, None, None), (202, "dos", "xx")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    trusted = df.where("doc_id < 90").select("doc_id")
    first = {(r["doc_id"], r["lang"]): r for r in classifier.classify(df, trusted).collect()}
    again = {(r["doc_id"], r["lang"]): r for r in classifier.classify(df.repartition(5), trusted).collect()}
    assert first.keys() == again.keys() and all(again[k] == r or abs(again[k]["perplexity"] - r["perplexity"]) < 1e-9 for k, r in first.items())
    held = {r[0] for r in df.select("doc_id", (F.pmod(F.xxhash64("text"), F.lit(10)) == 0).alias("h")).where("h").collect()}
    for lang in ("es", None):
        chars = lambda t: "".join(w + "\x03" for w in (t or "").split())
        p = plain_kneser_ney(["\x02" * 4 + chars(t) for i, t, x in rows if x == lang and i is not None and i < 90 and i not in held and chars(t)], 5)
        for i, t, x in rows:
            if x == lang and chars(t):
                s = "\x02" * 4 + chars(t)
                logp = sum(np.log(p(s[k : k + 5])) for k in range(len(s) - 4))
                assert abs(np.log(first[i, lang]["perplexity"]) + logp / (len(s) - 4)) < 1e-9
    assert first[202, "xx"]["perplexity"] is None and first[202, "xx"]["kept"] and not first[201, None]["kept"]
    assert classifier.classify(df.limit(0), trusted).count() == 0
    assert all(r["perplexity"] is None for r in classifier.classify(df, trusted.limit(0)).collect())


def test_model_sums_to_one(spark):
    rows = spark.createDataFrame([(1, "es", "aba abc bca", False)], "key bigint, lang string, text string, held boolean")
    model = classifier.train(rows, 3)
    grams = spark.createDataFrame([("es", "\x02a" + c) for c in "abc\x03"] + [("es", "\x02a?")], "lang string, gram string")
    assert abs(sum(np.exp(r["logp"]) for r in classifier.log_probabilities(grams, model).collect()) - 1) < 1e-9


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 16))
    x = np.concatenate([x, x[:20] + 0.1 * rng.normal(size=(20, 16)), x[:5]]).round(4)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [0.0] * 16), (102, [float("nan")] * 16), (103, [None] * 16), (104, [1.0, 2.0])]
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    root = np.arange(len(u))
    for _ in range(len(u)):
        root = np.minimum(root, np.where(link, root[None, :], 10**9).min(1))
    assert out == {i: (int(link[i].sum()), int(root[i])) for i in range(len(u))} | {i: (0, i) for i in range(100, 105)}


def test_embeddings_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 4)
    monkeypatch.setattr(embeddings, "BLOCK", 3)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16))
    x = np.concatenate([x, x[:300] + 0.1 * rng.normal(size=(300, 16)), x[:200] + 0.2 * rng.normal(size=(200, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    out = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    assert all(out[i]["n_links"] <= link[i].sum() for i in range(len(u)))
    assert sum(r["n_links"] for r in out.values()) >= 0.99 * link.sum() > 0
    ((width, visits, links, met),) = embeddings.recall(df, every=3)
    assert width == 16 and visits > 1 and links == link[::3].sum() and met >= 0.99 * links


def test_embeddings_repeated_keys_and_empty(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [0.0, 1.0]), (None, [1.0, 0.0]), (3, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"n": F.lit(1), "id": F.lit("x"), "v": F.lit(0)})
    out = sorted((r["vec_id"] or 0, r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect())
    assert [x[0] for x in out] == [0, 1, 1, 2, 3] and out[-1] == (3, 2, False) and out[-2] == (2, 2, True)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_quality_rules(spark):
    texts = [None, "", " ".join(f"w{i}" for i in range(60)), "a b c " * 30, "ONE " * 60, "x\n" * 60]
    out = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, texts, ("kept", "n_words")), statistics=True).collect()}
    assert out == {r["doc_id"]: r for r in quality_rules.judge(quality_rules.text_statistics(docs(spark, texts))).select(*out[0].asDict()).collect()} | {k: r for k, r in out.items() if r["rejected_by"]}
    assert quality_rules.judge(docs(spark, texts).limit(0), statistics=True).count() == 0
    assert [out[i]["kept"] for i in range(6)] == [False, False, True, False, False, False]
    assert [out[i]["n_repeat_words"] for i in range(4)] == [0, 0, 0, 90]
    assert out[5]["n_dup_lines"] == 59


@pytest.mark.parametrize("kinds", [None, 2, 1])
def test_repeat_words_brute_force(spark, monkeypatch, kinds):
    if kinds:  # nearly all hashes collide: only words can tell windows apart
        monkeypatch.setattr(quality_rules, "_window_hash", lambda w, i: F.pmod(F.xxhash64(F.get(w, i)), F.lit(kinds)))
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.text_statistics(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        w = t.split()
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        assert got[k] == len({i + d for i, x in enumerate(windows) if windows.count(x) > 1 for d in range(3)})


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    long = "<p>ñ</p>" * 40
    pages = spark.createDataFrame([(3, "u\r\nx", long), (1, "u", long), (2, None, None), (4, "u", "short"), (5, "u", "short")], "page_id bigint, url string, html string")
    warc.write_warc(warc.page_records(pages), str(tmp_path / "w"))
    got = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert len(got) == 5 and bytes(got["<urn:page:1>"]["payload"]) == long.encode()
    assert got["<urn:page:3>"]["record_type"] == "revisit" and got["<urn:page:3>"]["refers_to"] == "<urn:page:1>" and got["<urn:page:3>"]["target_uri"] == "u\r\nx"
    assert got["<urn:page:3>"]["payload_digest"] == "sha256:" + hashlib.sha256(long.encode()).hexdigest()
    only = warc.read_warc(spark, str(tmp_path / "w"), payload=False).where("record_type = 'revisit'")
    assert [r["payload"] for r in only.collect()] == [None]
    warc.write_warc(warc.page_records(pages.limit(0)), str(tmp_path / "empty"))
    assert warc.read_warc(spark, str(tmp_path / "empty")).count() == 0


def other_archive(records, gz):
    """WARC records as another writer makes them: no lengths, bare URIs, own order and case of fields."""
    import gzip

    out = b""
    for kind, uri, http, body in records:
        block = (b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" if http else b"") + body
        mime = "application/http; msgtype=response" if http else "text/plain"
        one = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Target-URI: {uri}\r\nContent-Type: {mime}\r\nContent-Length: {len(block)}\r\nWARC-Record-ID: <{uri}>\r\n\r\n".encode() + block + b"\r\n\r\n"
        out += gzip.compress(one) if gz == "each" else one
    return gzip.compress(out) if gz == "whole" else out


@pytest.mark.parametrize("gz", ["each", "whole", ""])
def test_warc_of_other_writers(spark, tmp_path, gz):
    own = [("warcinfo", "i", False, b"software: x"), ("response", "http://a/%20b?c=%C3%B1", True, b"\r\n\r\nbody" * 9000), ("request", "q", True, b""), ("response", "http://ñ/", True, "ñ".encode())]
    (tmp_path / "w" / "deep").mkdir(parents=True)
    name = "x.warc.gz" if gz else "x.warc"
    (tmp_path / "w" / "deep" / name).write_bytes(other_archive(own, gz))
    (tmp_path / "w" / "notes.txt").write_text("no archive")
    got = {r["target_uri"]: (r["record_type"], bytes(r["payload"]), r["payload_length"]) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert got == {u: (k, b, len(b)) for k, u, _, b in own}
    assert {r["target_uri"] for r in warc.read_warc(spark, str(tmp_path / "w"), payload=False).where("record_type = 'response'").collect()} == {own[1][1], own[3][1]}


def test_warc_is_read_by_gzip_and_checked(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "http://a/%20b", "x" * 200), (1, "a\x85 b", "y" * 300), (None, "u", "y" * 300), (None, None, ""), (5, "u", "z" * 200_000)], "page_id bigint, url string, html string")
    warc.write_warc(warc.page_records(pages), str(tmp_path / "w"))
    out = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted((r["target_uri"] or "", r["record_type"], r["payload_length"]) for r in out) == [("", "response", 0), ("a\x85 b", "response", 300), ("http://a/%20b", "response", 200), ("u", "response", 200_000), ("u", "revisit", 300)]
    files = sorted((tmp_path / "w").glob("*.warc.gz"))
    assert b"WARC-Target-URI: http://a/%20b\r\n" in b"".join(gzip.decompress(f.read_bytes()) for f in files)
    damaged = bytearray(warc.member({"WARC-Type": "response"}, b"HTTP/1.1 200 OK\r\n\r\nbody"))
    damaged[-8] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(warc.records(__import__("io").BytesIO(bytes(damaged)), lambda h: True, True))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    root = {i: i for e in edges for i in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: root[i] for a, b in edges if a != b for i in (a, b)}


def test_minhash_blocks_let_each_pair_meet_once(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = spark.createDataFrame([(k, i, 9) for k, m in ((1, 23), (2, 3), (3, 1)) for i in range(m)], "k bigint, id bigint, n bigint")
    cells = {}
    for r in minhash._dealt(rows).collect():
        cells.setdefault((r["k"], r["cell"]), []).append((r["id"], r["side"]))
    assert max(map(len, cells.values())) < 23
    met = sorted((k, *sorted((i, j))) for (k, _), own in cells.items() for n, (i, s) in enumerate(own) for j, t in own[:n] if s == 2 or s != t)
    assert met == [(k, i, j) for k, m in ((1, 23), (2, 3)) for i in range(m) for j in range(i + 1, m)]


@pytest.mark.parametrize("limit", [1, 200])
def test_minhash_cells_equal_brute_force(monkeypatch, limit):
    monkeypatch.setattr(minhash, "LOOKED_UP", limit)
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 1 << 60, 50).astype(np.uint64)) for _ in range(6)]
    sets = sorted((np.unique(np.concatenate([b[rng.permutation(50)[: rng.integers(40, 50)]], rng.integers(0, 1 << 60, rng.integers(0, 9)).astype(np.uint64)])) for b in base for _ in range(12)), key=len)
    n, c, size = [len(x) for x in sets], rng.integers(0, 30, len(sets)), len(sets)
    sigs = [minhash.signature(x).astype(np.uint8) for x in sets]
    for side in (np.full(size, 2), rng.integers(0, 2, size)):
        t = pa.table({"cell": np.zeros(size, np.int64), "n": n, "c": c, "side": side, "sig": [x.tobytes() for x in sigs], "shingles": [x.tobytes() for x in sets]})
        meet = [(i, j) for i in range(size) for j in range(i + 1, size) if c[i] != c[j] and (side[i] == 2 or side[i] != side[j]) and 80 * n[j] <= 100 * n[i] and (sigs[i] == sigs[j]).sum() >= minhash.MATCHES]
        links = [(i, j) for i, j in meet if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        assert links and np.flatnonzero(minhash.block_suspects(t, 80)).tolist() == sorted({k for p in meet for k in p})

        def joined(edges):
            root = c.copy()
            for i, j in edges:
                root[root == root[j]] = root[i]
            return [[bool(root[i] == root[j]) for j in range(size)] for i in range(size)]

        forest = minhash.cell_links(t, 80)
        assert set(forest) <= set(links) and len(forest) < 30 and joined(forest) == joined(links)
