"""Operators of the llm subpackage against brute force, round trips and odd inputs."""

import collections
import hashlib
import itertools
import math
import os
import random
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import bpe, chat, fingerprint, licenses, neardup, packing, quality, storage, substring, textvec, toxicity, url_filter

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for themselves.
CLASH = ["key", "h", "row", "doc", "score", "n_words", "kept", "part", "own_row", "copy", "begins", "at", "bucket", "words", "__key"]


def words(r, n, vocabulary=40):
    return " ".join(f"w{r.randrange(vocabulary)}{r.choice(['', ',', 'é'])}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls everywhere, empty, blank and very long texts, ties, repeated rows and near copies."""
    r = random.Random(7)
    base = words(r, 200, 5000)
    near = base.replace(base.split()[50], "changed", 1)
    rows = [
        (1, base, "en", "s", 1), (2, base, "en", "s", 1), (2, base, "en", "s", 1), (3, near, None, None, None), (4, None, "en", "s", None), (5, "", "en", "s", 0), (6, " \n\t ", "en", "s", 4),
        (None, "no id here", "en", "s", 3), (7, "one", "en", "s", 3), (8, "a b c", "en", "s", 5), (9, words(r, 30000, 9000), "en", "s", 9), (9, "same id, other text", "en", "s", 9), (10, "x" * 50000, "en", "s", 9),
    ]
    return rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, F.lit("other"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    """Small texts with shared passages and near copies."""
    r = random.Random(11)
    passages = [words(r, 40, 3000) for _ in range(4)]
    rows = []
    for i in range(120):
        body = words(r, r.randrange(0, 160), 3000).split()
        if i % 3 == 0:
            at = r.randrange(len(body) + 1)
            body[at:at] = r.choice(passages).split()
        if i % 10 == 9:
            body = rows[-r.randrange(1, 8)][1].split()
            for _ in range(r.randrange(0, 3)):
                if body:
                    body[r.randrange(len(body))] = "edit"
        rows.append((i, r.choice([" ", "  ", "\n"]).join(body)))
    return rows


def test_words_and_shingles():
    texts = ["a b", "", None, " x\x0by\x1cz ", "é\u00a0f g", "one two three four five six"]
    for at, rows, data, offsets in textvec.slices(pa.array(texts)):
        starts, ends, first = textvec.word_spans(data, offsets)
        got = [[bytes(data[s:e]) for s, e in zip(starts[first[t] : first[t + 1]], ends[first[t] : first[t + 1]], strict=True)] for t in range(rows)]
        assert got == [(t or "").encode().split() for t in texts]
    own = np.concatenate([at + o for at, _, o, _ in textvec.text_shingles(pa.array(texts), most_bytes=4)])
    assert np.bincount(own, minlength=6).tolist() == [1, 0, 0, 1, 1, 2]


def test_packing_tree_and_pieces(spark, odd, odd_rows, empty):
    r = random.Random(1)
    for window in (8, 64, 2048):
        lengths = sorted((r.randrange(1, window + 1) for _ in range(400)), reverse=True)
        rooms, where = [], []
        for n in lengths:
            fit = [(room, w) for w, room in enumerate(rooms) if room >= n]
            if fit and n < window:
                room = min(fit)[0]
                where.append(room)
                rooms[min(fit)[1]] -= n
            else:
                where.append(window)
                rooms.append(window - n)
        got, offsets, used = packing.best_fit(lengths, window)
        assert [window - o for o in offsets] == where and used == len(rooms)
    path = P.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    rows = packing.pack_documents(odd.where("doc_id IS NULL OR doc_id NOT IN (2, 9)").unionByName(odd.limit(0)), path, with_ids=True).collect()
    texts = {i: t or "" for i, t, *_ in odd_rows if i not in (2, 9)}
    by_doc, by_window = collections.defaultdict(list), collections.defaultdict(list)
    for x in rows:
        assert x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes()) and len(x.ids) == x.length
        by_doc[x.doc_id].append((x.start, x.ids))
        by_window[x.sequence_id].append((x.offset, x.length))
    for i, t in texts.items():
        assert sum((ids for _, ids in sorted(by_doc[i])), []) == [*whole.encode(t, add_special_tokens=False).ids, 1]
    for w in by_window.values():
        assert [o for o, _ in sorted(w)] == [sum(n for _, n in sorted(w)[:k]) for k in range(len(w))] and sum(n for _, n in w) <= 2048
    assert packing.pack_documents(empty, path).count() == 0
    windows = packing.sequences(packing.pack_documents(odd, path, with_ids=True))
    assert windows.where("size(ids) <> length OR length > 2048").count() == 0


@pytest.mark.parametrize("partitions", [1, 200])
def test_packing_leaves_little_room(spark, partitions):
    """Whatever the number of partitions; also where one row makes up a third of all."""
    r = random.Random(3)
    rows = [(i, words(r, int(r.expovariate(1 / 300)), 3000)) for i in range(600)] + [(7, words(r, 90, 3000))] * 300
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        packed = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), P.path("byte_bpe_50k.json")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(x.doc_tokens for x in packed if x.start == 0) == sum(x.length for x in packed)
    assert 1 - sum(x.length for x in packed) / (2048 * len({x.sequence_id for x in packed})) < 0.02


def test_packing_in_blocks(spark):
    rows = spark.createDataFrame([(i, "a b c d " * (i % 40)) for i in range(300)], "doc_id long, text string")
    packed = packing.pack_documents(rows, P.path("byte_bpe_50k.json"), window=64, shards=2, block=20).collect()
    by_window = collections.defaultdict(list)
    for x in packed:
        by_window[x.sequence_id].append((x.offset, x.length))
    for w in by_window.values():
        assert [o for o, _ in sorted(w)] == [sum(n for _, n in sorted(w)[:k]) for k in range(len(w))] and sum(n for _, n in w) <= 64


def test_storage_needs_a_shared_folder(spark):
    """A cluster without spark.checkpoint.dir is an error; tables go when dropped."""

    def session(master, folder=None):
        context = types.SimpleNamespace(master=master, setCheckpointDir=lambda at: None)
        context.getConf = lambda: types.SimpleNamespace(get=lambda name, default: folder)
        context._jsc = types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: types.SimpleNamespace(isEmpty=lambda: True, get=lambda: "set")))
        return types.SimpleNamespace(sparkContext=context)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.ensure_checkpoint_dir(session(master))
        assert storage.ensure_checkpoint_dir(session(master, "hdfs://shared")) == "set"
    rows = storage.table(spark.range(5))
    at = rows._table_path.removeprefix("file:")
    assert os.path.isdir(at) and rows.count() == 5
    storage.drop(rows)
    assert not os.path.exists(at)
    storage.drop(rows, spark.range(1))  # nothing to do


def test_special_tokens_in_texts(spark):
    path = P.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(path).encode("a<|endoftext|> b", add_special_tokens=False).ids
    rows = packing.pack_documents(spark.createDataFrame([(1, "a<|endoftext|> b")], "doc_id int, text string"), path, with_ids=True).collect()
    assert rows[0].ids == [*want, 1]


def test_bpe(spark, odd, odd_rows, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    two = bpe.TwoTier(ranks)
    assert all(two.hash.get(k) == i for i, k in enumerate(two.keys)) and two.hash.get(b"certainly no entry") is None
    encoder, r = bpe.ColumnEncoder(two.many, memo=200), random.Random(2)
    for _ in range(60):
        texts = ["".join(r.choice(" \n\t'strevemlld  ab12é漢!#\u00a0\u3000\x1c\x85ß😀") for _ in range(r.randrange(30))) for _ in range(20)]
        ids, cuts = encoder.encode(texts)
        assert [ids[cuts[i] : cuts[i + 1]].tolist() for i in range(20)] == [known.encode_ordinary(t) for t in texts]
    for t in ("a" * 3000, "'" * 9, " " * 70, "it's don't we'll 'll"):
        assert encoder.encode([t])[0].tolist() == known.encode_ordinary(t)
    got = bpe.encode_decode(odd, path).collect()
    want = collections.Counter()
    for i, t, *_ in odd_rows:
        ids = known.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, got)) == want
    assert bpe.encode_decode(empty, path).count() == 0
    plain = bpe.ColumnEncoder(two.many)
    plain.encode(["abc def"])
    plain.check[:] = 0  # as if other pre-tokens had the same hash
    assert plain.encode(["abc def", "", "def"])[0].tolist() == known.encode_ordinary("abc def") + known.encode_ordinary("def")
    back = bpe.decode_column(bpe.encode_column(odd, path), path).collect()
    assert sorted(bytes(x.decoded) for x in back) == sorted((t or "").encode() for _, t, *_ in odd_rows)


def brute_quality(t):
    t = t or ""
    w = [x.decode() for x in t.encode().split()]
    lines = [x for x in t.split("\n") if x.encode().split()]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {g for g, n in collections.Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, odd, odd_rows, empty):
    r = random.Random(4)
    texts = ["\n".join(" ".join(r.choice("ab|c#") for _ in range(r.randrange(6))) for _ in range(r.randrange(6))) for _ in range(80)] + ["a b c " * 3000 + " ".join(f"q{i // 2}" for i in range(8000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    for x in quality.judge(df).collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute_quality(texts[x.doc_id])
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words) and (not x.kept or not x.base_failed)
    assert quality.judge(odd).count() == len(odd_rows) and quality.judge(empty).count() == 0
    kept = quality.keep(odd)
    assert kept.columns == odd.columns
    mine = quality.judge(odd.withColumn("__q_mine", F.lit("a")).withColumn("__Q_text", F.lit("b"))).where("__q_mine = 'a' AND __Q_text = 'b'")
    assert mine.count() == len(odd_rows) and not [c for c in mine.columns if c.startswith("___")]
    assert quality.keep(empty).count() == 0
    # sorting windows with their places gives what the look-up gives
    long = " ".join(f"r{i % 4000}" for i in range(12000))
    x = quality.judge(spark.createDataFrame([(1, long)], "doc_id int, text string")).first()
    assert x.n_repeat_words == brute_quality(long)[4]


def brute_chat(rows, part):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, (role or "unknown").encode(), (text or "").replace("<|", "< |").encode()))
    out = {}
    for conv, turns in by.items():
        chunks = []  # equal turns count as one, up to `part` of them
        for _, same in itertools.groupby(sorted(turns)):
            same = list(same)
            chunks += [same[k : k + part] for k in range(0, len(same), part)]
        for who in {r.decode() for _, _, r, _ in turns} - {"system"}:
            for k in range(0, len(chunks), part):
                text, mask, n = "", [], 0
                for _, _, role, body in itertools.chain(*chunks[k : k + part]):
                    role, body = role.decode(), body.decode() + chat.END
                    text += "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == who else f"<|user:{role}|>\n"
                    if role == who:
                        mask.append(f"{len(text)}:{len(text) + len(body)}")
                    text += body
                    n += 1
                out[conv, who, k // part] = (n, text, ",".join(mask))
    return out


def test_chat(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "a<|b"), (1, 2, None, None), (1, 70, "user", "late"), (1, None, "bob", ""), (None, 0, "user", "x"), (2, 0, "system", "alone"), (1, 1, "user", "a<|b"), (3, 1, "é😀", "long " * 20000)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("part", F.lit(9)).withColumn("k", F.lit("clash"))
    got = {(x.conv_id, x.perspective, x.part): (x.n_turns, x.rendered, x.mask) for x in chat.perspectives(df).collect()}
    assert got == brute_chat(rows, chat.PART) and {k[:2] for k in got} == {(1, "user"), (1, "unknown"), (1, "bob"), (None, "user"), (3, "é😀")}
    assert got[1, "user", 0][1].startswith("<|user:bob|>\n<|end|>\n<|system|>\nS<|end|>\n" + "<|assistant|>\na< |b<|end|>\n" * 2)
    assert chat.perspectives(df.limit(0)).count() == 0


def test_chat_long_conversations(spark):
    """One conversation with most rows, many at one turn, many equal, many without a turn: no part grows with them."""
    r = random.Random(8)
    rows = [(1, r.choice([None, 1, 2, 3, r.randrange(500)]), r.choice("abc"), r.choice(["", "x", f"t{i}"])) for i in range(2000)] + [(1, 5, "a", "same")] * 150 + [(c, t, r.choice("ab"), "y") for c in range(2, 30) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(6)
    got = {(x.conv_id, x.perspective, x.part): (x.n_turns, x.rendered, x.mask) for x in chat.perspectives(df, 16).collect()}
    assert got == brute_chat(rows, 16) and max(n for n, *_ in got.values()) <= 16 * 16


def test_urls(spark):
    urls = [
        ("http://A.Example.NET/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"), ("https://net", "net", "", None, "allow"), ("x://net/", "net", "/", "net/", "block"),
        ("https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), ("https://notexample.com/de/", "notexample.com", "/de/", None, "allow"), ("https://a.org/fr/x#y?z", "a.org", "/fr/x", "org/fr/", "allow"),
        ("no url", "", "", None, "allow"), (None, "", "", None, "allow"), ("a://É.com?x://y/", "É.com", "", None, "allow"), ("https://bad.com/x", "bad.com", "/x", None, "block"),
    ]
    pages = spark.createDataFrame([(i, u[0]) for i, u in enumerate(urls)], "page_id int, url string").withColumn("host", F.lit("clash"))
    seen = [(f"https://bad.com/{i}", 1) for i in range(60)] + [(f"https://h{i % 9}.com/", 0) for i in range(400)] + [("https://few.com/", 1), (None, 1), ("https://n.com", None)]
    outcomes = spark.createDataFrame(seen, "url string, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, outcomes).collect()}
    assert got == {i: u[1:] for i, u in enumerate(urls)}
    assert url_filter.judge(pages.limit(0), outcomes).count() == 0
    long = "https://" + "a." * 3000 + "net/" + "p/" * 20000 + "?q"
    odd = spark.createDataFrame([(1, ""), (2, long), (2, long), (3, "://"), (4, "https:///path"), (None, "https://bad.com/")], "page_id int, url string")
    rules = (("block", "bad.com/"), ("allow", "net/pp/"), ("block", "a.net/p/"), ("allow", "net/p/p/"))  # the last two fit and are equally long: the later one counts
    found = collections.Counter((x.page_id, len(x.host), len(x.path), x.rule, x.verdict) for x in url_filter.judge(odd, outcomes, rules).collect())
    assert found == {(1, 0, 0, None, "allow"): 1, (2, 6003, 40001, "net/p/p/", "allow"): 2, (3, 0, 0, None, "allow"): 1, (4, 0, 5, None, "allow"): 1, (None, 7, 1, "bad.com/", "block"): 1}
    assert {r.verdict for r in url_filter.judge(pages, outcomes.limit(0)).where("rule IS NULL").collect()} == {"allow"}


def test_licenses(spark, odd, empty):
    r = random.Random(6)
    names = list(licenses.TEMPLATES)
    texts = []
    for i in range(150):
        body = words(r, r.randrange(0, 120)).split()
        for _ in range(r.randrange(3)):
            notice = licenses.TEMPLATES[r.choice(names)].split()
            if r.random() < 0.4:
                notice[r.randrange(len(notice))] = "other"
            at = r.randrange(len(body) + 1)
            body[at:at] = notice
        texts.append(" ".join(body))
    scanner = licenses.Scanner(licenses.TEMPLATES)
    got = collections.defaultdict(set)
    for at, rows, own, values in licenses.shingle_runs(pa.array(texts)):
        for t, k, share, _ in scanner.scan(own, values, rows):
            got[at + t].add(names[k])
        for t in range(rows):
            mine = values[own == t]
            for k, s in enumerate(scanner.sets):
                block = 1 << (len(s) - 1).bit_length()
                whole = any(np.isin(s, mine[i : i + 2 * block]).mean() >= licenses.CONTAINMENT for i in range(0, max(1, len(mine)), block)) if len(mine) else False
                assert (names[k] in got[at + t]) == whole, (at + t, names[k])
    assert any(got.values())
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0
    one = licenses.scan(spark.createDataFrame([(1, "x Released under the MIT License. y"), (1, None)], "doc_id int, text string").withColumn("license", F.lit(1))).collect()
    assert [(x.doc_id, x.license, x.containment) for x in one] == [(1, "mit-line", 1.0)]


def test_empty_bins():
    """Bins filled from a table or by attempts hold what attempts alone find."""
    r = np.random.default_rng(5)
    bins = 128
    least = np.full((60, bins), fingerprint._NONE)
    for i in range(60):
        full = r.choice(bins, [0, 1, 2, 5, 31, 32, 33, 60, 127, 128][i % 10], replace=False)
        least[i, full] = r.integers(0, 2**63, len(full)).astype(np.uint64)
    got = fingerprint.densify(least)
    for i in range(60):
        for j in range(bins):
            if (least[i] == fingerprint._NONE).all():
                assert got[i, j] == fingerprint._NONE
                continue
            at, attempt = j, 0
            while least[i, at] == fingerprint._NONE:
                attempt += 1
                at = int(fingerprint._source(np.array([j]), attempt, bins)[0])
            assert got[i, j] == least[i, at]


def test_fingerprints(spark, odd, odd_rows, empty, corpus):
    df = spark.createDataFrame(corpus, "doc_id int, text string").repartition(5)
    got = {x.doc_id: x for x in fingerprint.with_edits(df, parts=7).collect()}
    n = len(corpus)
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))} if t.split() else set()
    errors = []
    for k, (i, t) in enumerate(corpus):
        after = corpus[(k + 1) % n][1]
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        x = got[i]
        assert x.edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and x.n_chars == len(t)
        for other, near in ((new, x.near_edited), (after, x.near_next)):
            a, b = shingles(t), shingles(other)
            errors.append(near - (len(a & b) / len(a | b) if a | b else 1.0))
    assert np.abs(errors).max() < 0.12 and abs(np.mean(errors)) < 0.01
    rows = fingerprint.with_edits(odd, parts=3).collect()
    assert len(rows) == len(odd_rows) and sorted(x.doc_id for x in rows if x.doc_id is not None) == sorted(i for i, *_ in odd_rows if i is not None)
    assert len({x.fingerprint for x in rows if x.doc_id in (1, 2)}) == 1
    assert fingerprint.with_edits(empty).count() == 0 and fingerprint.fingerprint_column(odd).count() == len(odd_rows)
    single = fingerprint.with_edits(odd.where("doc_id = 3")).collect()
    assert len(single) == 1 and single[0].near_next == 1.0


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = t.encode().split()
        keep = [True] * len(w)
        for j in range(len(w) - 19):
            g = tuple(w[j : j + 20])
            if g in seen:
                keep[j : j + 20] = [False] * 20
            seen.add(g)
        out[i] = len(w), keep.count(False), hashlib.sha256(b" ".join(x for x, k in zip(w, keep, strict=True) if k)).hexdigest()
    return out


@pytest.mark.parametrize("group", [100_000, 2])
def test_substrings(spark, corpus, monkeypatch, group):
    monkeypatch.setattr(substring, "GROUP", group)
    rows = [*corpus, (500, "p q r " * 40), (501, corpus[3][1]), (502, corpus[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring.cut_repeats(df, digest=True).collect()}
    want = brute_repeats(rows)
    assert got == want and sum(x[1] for x in want.values()) > 500
    for x in substring.cut_repeats(df).collect():
        assert hashlib.sha256(b" ".join(x.text.encode().split())).hexdigest() == want[x.doc_id][2]


def brute_nodes(rows):
    """Maximal repeats of WINDOW words or more, cut at DEPTH, of distinct texts: (first doc, place, words) -> occurrences."""
    texts, seen = [], set()
    for i, t in sorted(rows):
        if t not in seen:
            seen.add(t)
            texts.append((i, t.encode().split()))
    at = collections.defaultdict(list)
    for i, w in texts:
        for j in range(len(w) - substring.WINDOW + 1):
            for n in range(substring.WINDOW, min(substring.DEPTH, len(w) - j) + 1):
                at[tuple(w[j : j + n])].append((i, j, w[j - 1] if j else None, w[j + n] if j + n < len(w) else None))
    out = {}
    for g, where in at.items():
        before, after = [b for *_, b, _ in where], [a for *_, a in where]
        many = lambda xs: len(set(xs)) > 1 or None in xs
        if len(where) > 1 and many(before) and (many(after) or len(g) == substring.DEPTH):
            i, j, *_ = min(x[:2] for x in where)
            out[i, j, len(g)] = len(where)
    return out


def test_maximal_repeats(spark, corpus):
    rows = [*corpus, (500, "p q r " * 40), (501, corpus[3][1]), (502, "zz " + corpus[3][1])]
    df = spark.createDataFrame(rows, "doc long, text string").repartition(4)
    got = {(x["doc"], x["at"], x["words"]): x["occurrences"] for x in substring.maximal_repeats(df).collect()}
    assert got == brute_nodes(rows) and {n for *_, n in got} > {20, substring.DEPTH} and max(got.values()) > 2


def test_suffix_tree_nodes():
    r = random.Random(5)
    for _ in range(50):
        suffixes = sorted("".join(r.choice("ab") for _ in range(6)) for _ in range(r.randrange(1, 14)))
        common = np.array([0] + [len(os.path.commonprefix(p)) for p in itertools.pairwise(suffixes)])
        tree, rank = substring.SuffixTree(common, 5), np.array(r.sample(range(len(suffixes)), len(suffixes)))
        for depth in range(2, 6):
            want = {}
            for i, j in itertools.combinations(range(len(suffixes)), 2):
                shared = min(5, len(os.path.commonprefix([suffixes[i], suffixes[j]])))
                if shared == depth:
                    prefix = suffixes[i][:depth]
                    want[next(k for k, x in enumerate(suffixes) if x.startswith(prefix))] = sum(x.startswith(prefix) for x in suffixes)
            assert dict(zip(*(x.tolist() for x in tree.nodes(depth)), strict=True)) == want
        deepest = [max([min(5, len(os.path.commonprefix([x, y]))) for j, y in enumerate(suffixes) if rank[j] < rank[i]], default=0) for i, x in enumerate(suffixes)]
        assert tree.repeated(rank, 2).tolist() == [d if d >= 2 else 0 for d in deepest]


def test_substrings_odd(spark, odd, odd_rows, empty):
    rows = substring.cut_repeats(odd, digest=True).collect()
    assert len(rows) == len(odd_rows) and {x.n_removed for x in rows if x.doc_id == 2} == {200} and {x.n_removed for x in rows if x.doc_id == 1} == {0}
    texts = substring.cut_repeats(odd)
    assert texts.columns == odd.columns and texts.count() == len(odd_rows)
    assert substring.cut_repeats(empty, digest=True).count() == 0 and substring.cut_repeats(empty).count() == 0


def brute_classes(rows):
    count = {i: collections.Counter(tuple(w[k : k + 5]) for w in [t.encode().split()] for k in range(max(1, len(w) - 4))) if t.split() else None for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, t in rows:
        for b, u in rows:
            if a < b:
                x, y = count[a], count[b]
                alike = t == u or (x and y and sum((x & y).values()) >= 0.8 * sum((x | y).values()))
                if alike:
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in rows}


def test_near_duplicates(spark, corpus):
    r = random.Random(12)
    base = words(r, 120, 4000).split()
    rows = list(corpus)
    for i in range(60):  # a family whose members are alike in chains
        w = list(base)
        for _ in range(r.randrange(9)):
            w[r.randrange(len(w))] = f"e{r.randrange(50)}"
        rows.append((1000 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.class_id for x in neardup.classes(df).collect()}
    assert got == brute_classes(rows)
    kept = {x.doc_id for x in neardup.keep_one(df).collect()}
    assert kept == set(got.values())


def test_near_duplicates_odd(spark, odd, odd_rows, empty):
    found = neardup.classes(odd).collect()
    assert len(found) == len(odd_rows) and {x.class_id for x in found if x.doc_id in (1, 2, 3)} == {1}
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((x.doc_id, x.text) for x in kept.collect() if x.doc_id in (1, 2, 3, 9))[0][0] == 1 and kept.where("doc_id IN (2, 3)").count() == 0
    assert neardup.classes(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def test_keep_one_of_each_class(spark):
    """Classes without doc_id, and unlike texts that share one, each keep a row of their own."""
    r = random.Random(14)
    a, b, c, d, e = (words(r, 60, 5000) for _ in range(5))
    near = a.replace(a.split()[30], "changed", 1)
    rows = [(None, a), (None, a), (None, near), (None, b), (1, c), (1, d), (1, d), (2, c), (None, d), (3, e), (3, e + " more"), (None, None), (4, "")]
    kept = [tuple(x) for x in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert len(kept) == 6 and sum(x in ((None, a), (None, near)) for x in kept) == 1 and sum(x in ((3, e), (3, e + " more")) for x in kept) == 1
    assert {(None, b), (1, c), (1, d), (4, "")} <= set(kept)


def test_near_duplicate_copies(spark):
    """A text with most rows as copies, spread over tasks, and unlike texts that share a frequent passage."""
    r = random.Random(21)
    hot, passage = words(r, 80, 5000), words(r, 30, 5000)
    rows = [(i, hot) for i in range(300)] + [(300 + i, passage + " " + words(r, 60, 5000)) for i in range(40)] + [(400 + i, " ".join([*hot.split()[:-1], f"end{i}"])) for i in range(30)]
    got = {x.doc_id: (x.class_id, x.class_size) for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    want = brute_classes(rows)
    assert {i: c for i, (c, _) in got.items()} == want and got[5] == (0, 330)


def test_dart_signatures_estimate_weighted_likeness():
    r = np.random.default_rng(3)
    elements = textvec.mix64(np.arange(300, dtype=np.uint64))
    a, b = r.choice([0.0, 0.5, 1.0, 2.5], 300), r.choice([0.0, 0.5, 1.0, 2.5], 300)
    b[:200] = a[:200]
    own = np.concatenate([np.zeros(300, int), np.ones(300, int)])
    keep = np.concatenate([a, b]) > 0
    sig, has = neardup.darts(own[keep], np.concatenate([elements, elements])[keep], np.concatenate([a, b])[keep], 3, 1024)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.06 and has.tolist() == [True, True, False]


def test_toxicity(spark, odd, odd_rows, empty):
    r = random.Random(9)
    bad = ["vile", "nasty", "rotten"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        w = words(r, 60, 400).split()
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(bad) + r.choice([".", "", "!"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.classify(df.withColumn("score", F.lit("x")), known).collect()}
    out = [(got[i].predicted, t) for i, t in labels if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    assert np.mean([p == t for p, t in out]) > 0.95
    # labels of the held-out fold change nothing
    flipped = known.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {x.doc_id: x.score for x in toxicity.classify(df, flipped).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in again)
    scored = toxicity.classify(odd, known).collect()
    assert len(scored) == len(odd_rows) and all(0 <= x.score <= 1 for x in scored)
    assert toxicity.classify(empty, known).count() == 0
    assert max(x.score for x in toxicity.classify(odd, known.limit(0)).collect()) < 1e-5


def plain_em(fired, count, toxic, prior, parents):
    """The label model text by text, in plain loops; parents: those to use once independent voters have come to rest."""
    n, m = len(fired), len(toxic)
    p = [0.9 if sum(f * (1 if t else -1) for f, t in zip(row, toxic, strict=True)) > 0 else 0.1 * prior for row in fired]
    for parent in ([-1] * m, parents):
        for _ in range(200):
            by = [[(1 - p[k]) * count[k] for k in range(n)], [p[k] * count[k] for k in range(n)]]

            def held(hits, texts, side):
                rate = [hits[c] / texts[c] for c in range(2)]
                return [sum(hits) / sum(texts)] * 2 if (rate[1] < rate[0] if side else rate[0] < rate[1]) else rate

            rate = [held([sum(by[c][k] * fired[k][j] for k in range(n)) + 0.5 for c in range(2)], [sum(by[c]) + 1 for c in range(2)], toxic[j]) for j in range(m)]
            chance = [[[rate[j][c]] * 2 for c in range(2)] for j in range(m)]
            for j in range(m):
                for v in range(2) if parent[j] >= 0 else ():
                    own = [k for k in range(n) if fired[k][parent[j]] == v]
                    got = held([sum(by[c][k] * fired[k][j] for k in own) + rate[j][c] for c in range(2)], [sum(by[c][k] for k in own) + 1 for c in range(2)], toxic[j])
                    for c in range(2):
                        chance[j][c][v] = got[c]
            new = []
            for row in fired:
                odds = [prior if c else 1 - prior for c in range(2)]
                for j in range(m):
                    for c in range(2):
                        x = chance[j][c][row[parent[j]] if parent[j] >= 0 else 0]
                        odds[c] *= x if row[j] else 1 - x
                new.append(odds[1] / sum(odds))
            moved, p = max(abs(a - b) for a, b in zip(p, new, strict=True)), new
            if moved < 1e-9:
                break
    return p, rate


def test_label_model():
    r = np.random.default_rng(4)
    n = 4000
    y = r.random(n) < 0.2
    rates = [(0.7, 0.03), (0.6, 0.05), (0.5, 0.02), (0.1, 0.4), (0.65, 0.08)]
    fired = np.stack([np.where(y, r.random(n) < a, r.random(n) < b) for a, b in rates], axis=1).astype(int)
    fired = np.concatenate([fired, np.where(r.random((n, 1)) < 0.95, fired[:, :1], 1 - fired[:, :1])], axis=1)  # nearly a copy of the first voter
    toxic = np.array([True, True, True, False, True, True])
    rows, count = np.unique(fired, axis=0, return_counts=True)
    p, model = toxicity.label_model(rows, count.astype(float), toxic, 0.2)
    assert {(0, 5), (5, 0)} & {(j, int(model.parent[j])) for j in range(6)}  # the copy and its original are neighbours
    want, want_rates = plain_em(rows.tolist(), count.tolist(), toxic.tolist(), 0.2, model.parent.tolist())
    assert np.abs(p - want).max() < 1e-6 and np.abs(model.rate.T - want_rates).max() < 1e-6
    assert np.abs(model.rate[1, :5] - [a for a, _ in rates]).max() < 0.08 and np.abs(model.rate[0, :5] - [b for _, b in rates]).max() < 0.04
    each = {tuple(row): x for row, x in zip(rows.tolist(), p, strict=True)}
    assert np.mean((np.array([each[tuple(f)] for f in fired.tolist()]) >= 0.5) == y) > 0.93
    both, alone = each[1, 0, 0, 0, 0, 1], each[0, 1, 0, 0, 0, 0]
    assert abs(math.log(both / (1 - both)) - math.log(alone / (1 - alone))) < 1.5  # a voter and its copy say little more than one voter


def plain_logistic(lists, target, weight, words_, l2=1e-5):
    """Plain gradient descent to the same optimum, for a few words."""
    w, bias, total = dict.fromkeys(words_, 0.0), 0.0, sum(weight)
    for _ in range(6000):
        error = [(1 / (1 + math.exp(-(bias + sum(w[x] for x in has)))) - t) * c / total for has, t, c in zip(lists, target, weight, strict=True)]
        for x in words_:
            w[x] -= 2.0 * (sum(e for e, has in zip(error, lists, strict=True) if x in has) + l2 * w[x])
        bias -= 2.0 * sum(error)
    return w, bias


def test_regression():
    r = random.Random(6)
    lists = [[k for k in range(3) if r.random() < 0.4] for _ in range(60)]
    target, weight = [0.1 + 0.25 * len(x) for x in lists], [r.choice([1.0, 3.0]) for _ in lists]
    w, bias = plain_logistic(lists, target, weight, range(3))
    row = np.repeat(np.arange(60), [len(x) for x in lists])
    got = toxicity.regress(60, row, np.array([k for x in lists for k in x]), np.arange(3, dtype=np.uint64), np.array(target), np.array(weight), rounds=4000)
    assert np.abs(got.weights - [w[k] for k in range(3)]).max() < 0.02 and abs(got.bias - bias) < 0.02


def test_votes():
    texts = ["you are an Idiot", "idiot. You", "sh**t here", "soooo good", "WHY ARE YOU ALL SHOUTING HERE", "what!!!", "a!! b", "see http://x.org", "worthless clown, pathetic", None, "", "plain text", "über vorzüglich"]
    code = toxicity.Voting(toxicity.Mined(toxicity.hashes_of("plain"), np.zeros(0, np.uint64), toxicity.hashes_of("über"))).codes(pa.array(texts))
    fired = [{n for n, _ in toxicity.VOTERS if c & toxicity.BIT[n]} for c in code.tolist()]
    assert fired == [{"mind", "address"}, {"mind"}, {"masked"}, {"stretched"}, {"shouting"}, {"marks"}, set(), {"links"}, {"mind", "worth", "themes"}, set(), set(), {"mined words"}, {"mined clean words"}]


def test_telling_words(spark):
    """A passage's words don't count for each of its near copies; a word that turns up in many places does."""
    r = random.Random(13)
    passage = words(r, 60, 100000).split()
    rows = [(1.0, " ".join(x if r.random() > 0.05 else f"e{r.randrange(9999)}" for x in passage)) for _ in range(80)]
    rows += [(1.0, " ".join([*words(r, 20, 400).split(), "vile", *words(r, 20, 400).split()])) for _ in range(40)] + [(0.0, words(r, 50, 400)) for _ in range(150)]
    found, q, _ = toxicity.telling(spark.createDataFrame(rows, "y double, text string").repartition(3), toxicity._words_only)
    assert found.tolist() == toxicity.hashes_of("vile").tolist() and q.tolist() == [1.0]


def test_conflicting_labels(spark):
    """A doc_id labelled both ways has no label; the same label twice is one."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(1, 12)], "doc_id long, text string")
    ids = [i for i in range(1, 12) if zlib.crc32(str(i).encode()) % 5]
    labels = [(i, 0) for i in ids] + [(ids[0], 1), (ids[1], 0), (None, 1), (ids[2], None)]
    rows, counts = toxicity.labelled_texts(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert counts == {0: len(ids) - 1} and sorted(x.text for x in rows.collect()) == sorted(f"text {i}" for i in ids[1:])


def test_pipeline_stages(spark, tmp_path, corpus, odd_rows):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, " the ".join(t.split()), "en", "s", len(t)) for i, t in corpus[:60]]
    for name, part in (("full", [*rows, *((1000 + k, *x[1:]) for k, x in enumerate(odd_rows))]), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(part, SCHEMA).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for stage, f in corpus_pipeline.STAGES[:-1]:
            after = storage.table(f(spark, docs, str(folder)))
            assert after.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", "), stage
            docs = after
        out = corpus_pipeline.STAGES[-1][1](spark, docs, str(folder))
        assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        assert (out.count() == 0) == (name == "none")


def brute_keeps(t):
    n, chars, symbols, dup, repeat = brute_quality(t)
    lines = [x for x in t.split("\n") if x.encode().split()]
    listed = [w.decode() for w in t.encode().split()]
    if n < 50 or 100 * repeat > 50 * n:
        return False
    letters, upper = sum(c.isalpha() for c in t), sum(c.isupper() for c in t)
    return 2 <= chars / n <= 20 and symbols <= 0.15 * n and t.count("!") <= 0.5 * n and upper <= 0.5 * max(letters, 1) and sum(w.lower() in quality.STOP_WORDS for w in listed) >= 0.02 * n and dup <= 0.5 * max(len(lines), 1)


def brute_cut(rows):
    """Texts without the windows of 20 words that start earlier, kept runs of words as they were."""
    import re

    seen, out = set(), {}
    for i, t in sorted(rows):
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        w, keep = [t[a:b] for a, b in spans], [True] * len(spans)
        for j in range(len(w) - 19):
            g = tuple(w[j : j + 20])
            if g in seen:
                keep[j : j + 20] = [False] * 20
            seen.add(g)
        runs = [list(g) for k, g in itertools.groupby(range(len(w)), key=keep.__getitem__) if k]
        out[i] = t if all(keep) else "\n".join(t[spans[g[0]][0] : spans[g[-1]][1]] for g in runs)
    return out


def test_pipeline_against_brute_force(spark, tmp_path, corpus):
    """All five stages on a corpus with toxic, poor, near-duplicate and repeating texts give the pieces that plain code gives."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    r = random.Random(31)
    base = [(i, " the ".join(t.split())) for i, t in corpus]
    rows = base + [(200 + i, " the ".join(words(r, 60, 800).split())) for i in range(120)]
    labels = []
    for k, (i, t) in enumerate(rows):
        if k % 4 == 1:
            w = t.split() or ["the"]
            for _ in range(3):
                w.insert(r.randrange(len(w) + 1), r.choice(["idiot", "scum", "worthless"]))
            rows[k] = (i, " ".join(w))
        labels.append((i, 1, int(k % 4 == 1)))
    rows += [(400, None), (401, ""), (402, rows[8][1]), (403, rows[8][1] + " more")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known.write.parquet(str(tmp_path / "labels.parquet"))
    got = {(x.doc_id, x.start): (x.length, x.ids_crc32, x.doc_tokens) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), known)
    score = model.score(pa.array([t for _, t in rows]))
    insulted = [i for i, t in rows if t and {"idiot", "scum", "worthless"} & set(t.split())]
    assert sorted(i for (i, _), x in zip(rows, score, strict=True) if x >= 0.5) == sorted(insulted)
    good = [(i, t or "") for i, t in rows if i not in insulted and brute_keeps(t or "")]
    classes = brute_classes(good)
    cut = brute_cut([(i, t) for i, t in good if classes[i] == i])
    assert 40 < len(cut) < len(good) < len(rows) - len(insulted) and any(t != dict(good)[i] for i, t in cut.items())
    whole, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), {}
    for i, t in cut.items():
        ids = [*whole.encode(t, add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), 2048):
            piece = ids[a : a + 2048]
            want[i, a] = len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)
    assert got == want
