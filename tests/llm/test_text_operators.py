"""The text operators against brute force and on awkward rows: NULLs, empty and long texts, ties, repeats, empty tables, clashing columns."""
import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planlens.llm import chat, decontaminate, fingerprints, line_dedup, mixing, near_dedup, sharding, substring_dedup, toxicity, warc
from planlens.llm.common import FIRST, Scratch, components
from planlens.llm.queries import read_back

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, cells string, row string, score string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [a + b for a in ("ka", "Lo", "mí", "nu", "re", "x") for b in ("ta", "re", "si", "9", "ö")]
    passage = [" ".join(rng.choices(vocabulary, k=70)) for _ in range(3)]
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0 and texts:
            texts.append(rng.choice(texts))  # an exact copy
        elif kind == 1 and texts:
            words = rng.choice(texts).split(" ")
            words[rng.randrange(len(words))] = "edited"
            texts.append(" ".join(words))  # a near copy
        elif kind == 2:
            texts.append("\n".join([" ".join(rng.choices(vocabulary, k=30)), rng.choice(passage), "Shared  LINE \t", " ".join(rng.choices(vocabulary, k=25))]))
        else:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.randrange(1, 120))) + rng.choice(["", "\n", "\x0b\u00a0 shared  line"]))
    return texts


AWKWARD = ["", " \t\n", "one", "one two", "\n\n", "ÀÉ ß\u2028x", "a " * 30000, "same same same same same same", "\\</s>[INST]\\\\", "x" * 5000]


@pytest.fixture(scope="module")
def rows():
    out = [(10 + 3 * i, t, "en", f"src{i % 3}", len(t), "a", "b", "c", "d") for i, t in enumerate(corpus() + AWKWARD)]
    out.append((5000, None, None, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Also NULL ids and rows that repeat."""
    return spark.createDataFrame(rows + rows[:5] + [(None, *r[1:]) for r in rows[:12]] * 2, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=str)


def sets_of(rows, size):
    out = {}
    for r in rows:
        w = WORD.findall(low(r[1] or ""))
        out[r[0]] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    return out


def classes(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in sets}


# ---------------------------------------------------------------- 1 substrings

@pytest.mark.parametrize("window", [50, 7, 1])
def test_repeated_windows_go(docs, rows, window):
    first, want = {}, []
    words = sorted((r[0], WORD.findall(r[1] or "")) for r in rows)
    for i, w in words:
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k:k + window]), i)
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), sha(left), left))
    out = substring_dedup.remove_repeats(docs, window)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text") == sorted(want, key=str)
    for r in out.collect():
        assert sum(r.removed[1::2]) - sum(r.removed[::2]) == r.n_removed


def test_substrings_of_odd_rows(odd, none):
    out = substring_dedup.remove_repeats(odd, 7, with_text=False)
    assert out.count() == odd.count()
    # a copy without id is later than any id, and rows with one id spare each other
    assert out.where("doc_id is null and n_words >= 7 and n_removed < n_words").count() == 0
    assert substring_dedup.remove_repeats(none).collect() == []


# ---------------------------------------------------------------- 2 shards

def test_shards_are_even_whole_and_repeatable(odd, rows):
    a, b = (sharding.shuffled_shards(odd, 7, bucket_bytes=20000) for _ in range(2))
    assert got(a, "doc_id", "text", "shard", "slot") == got(b, "doc_id", "text", "shard", "slot")
    assert got(a, "doc_id", "text") == got(odd, "doc_id", "text")
    sizes = collections.Counter(r.shard for r in a.collect())
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in range(7):
        assert sorted(r.slot for r in a.where(f"shard = {k}").collect()) == list(range(sizes[k]))
    assert a.columns == [c for c in odd.columns if c != "shard"] + ["shard", "slot"]


def test_shards_are_shuffled_and_written(spark, docs, none):
    ids = [r.doc_id for r in sorted(sharding.shuffled_shards(docs, 1).collect(), key=lambda r: r.slot)]
    assert ids != sorted(ids)
    path = Scratch(spark).path()
    sharding.write_shards(docs, path, 3)
    assert spark.read.parquet(path).groupBy("shard").count().count() == 3
    assert sharding.shuffled_shards(none).collect() == []


# ---------------------------------------------------------------- 3 lines

@pytest.mark.parametrize("least", [1, 4, 11])
def test_frequent_lines_go(docs, rows, least):
    keys = {r[0]: [low(x.strip("\x20\t\n\x0b\x0c\r")) for x in (r[1] or "").split("\n")] for r in rows}
    held = collections.Counter(k for ks in keys.values() for k in set(ks) if k)
    want = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        left = [x for x, k in zip(lines, keys[r[0]]) if held[k] < least]
        want.append((r[0], len(lines), len(lines) - len(left), "\n".join(left)))
    assert got(line_dedup.drop_frequent_lines(docs, least), "doc_id", "n_lines", "n_dropped", "kept_text") == sorted(want, key=str)


def test_lines_of_odd_rows(odd, none):
    assert line_dedup.drop_frequent_lines(odd, 3).count() == odd.count()
    assert line_dedup.drop_frequent_lines(none).collect() == []


# ---------------------------------------------------------------- 4 fingerprints

@pytest.mark.parametrize("range_bytes", [1 << 30, 5000])
def test_neighbours_and_edits(docs, rows, range_bytes):
    order = sorted(rows, key=lambda r: -r[0])
    want = []
    for r, after in zip(order, order[1:] + order[:1]):
        a, b = r[1] or "", after[1] or ""
        want.append((r[0], len(a), sha(a[:len(a) - len(a) // 2] + b[:len(a) // 2])))
    out = fingerprints.fingerprint_neighbours(docs, range_bytes=range_bytes)
    assert got(out, "doc_id", "n_chars", "edited_sha256") == sorted(want, key=str)
    prints = {r.doc_id: r.fingerprint for r in out.collect()}
    texts = {r[0]: r[1] or "" for r in rows}
    by_text = collections.defaultdict(set)
    for i, p in prints.items():
        by_text[texts[i]].add(p)
    assert all(len(p) == 1 for p in by_text.values())
    for r in out.collect():
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (texts[r.doc_id] != "") or r.near_edited == 1


def test_likeness_estimates_jaccard():
    rng = random.Random(2)
    words = [str(rng.random()) for _ in range(400)]
    a, b = " ".join(words), " ".join(words[:300] + [str(rng.random()) for _ in range(100)])
    s = sets_of([(0, a), (1, b)], 5)
    prints = fingerprints.fingerprints(pa.array([a, b]))
    assert abs((prints[0] == prints[1]).mean() - len(s[0] & s[1]) / len(s[0] | s[1])) < 0.2


def test_neighbours_of_odd_rows(spark, odd, none):
    assert fingerprints.fingerprint_neighbours(odd, range_bytes=5000).count() == odd.count()
    assert fingerprints.fingerprint_neighbours(none).collect() == []
    alone = fingerprints.fingerprint_neighbours(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).first()
    assert alone.edited_sha256 == sha("a b c" + " d " + "a b c") or alone.edited_sha256 == sha("a b c "[:6] + "a b c"[:5])


def test_band_pairs_are_true(docs, rows):
    s = sets_of(rows, 5)
    for a, b in got(fingerprints.similar_pairs(docs), "a", "b"):
        n = len(s[a] & s[b])
        assert a > b and 100 * n >= 80 * len(s[a] | s[b])


def test_unlike_hubs_hide_no_pair(spark):
    rng = random.Random(8)
    words = [str(rng.random()) for _ in range(300)]
    edited = lambda n: " ".join(str(rng.random()) if k in set(range(at, at + n)) else w for at in [rng.randrange(300 - n)] for k, w in enumerate(words))
    # smaller ids in every band of the two last, none of them like either
    group = [(i, edited(45)) for i in range(1, 61)] + [(100, " ".join(words)), (101, edited(6))]
    sets = sets_of(group, 5)
    assert all(100 * len(sets[i] & sets[j]) < 80 * len(sets[i] | sets[j]) for i in range(1, 61) for j in (100, 101))
    prints = fingerprints.fingerprints(pa.array([t for _, t in group])).reshape(62, fingerprints.BANDS, -1)
    assert (prints[:60] == prints[60]).all(2).any(0).all()
    want, root = classes(sets), {i: i for i in sets}
    for a, b in got(fingerprints.similar_pairs(spark.createDataFrame(group, "doc_id long, text string")), "a", "b"):
        root = {i: min(root[a], root[b]) if r in (root[a], root[b]) else r for i, r in root.items()}
    assert root == want and want[101] == 100


def test_many_near_copies_make_few_links(spark):
    """2,000 near copies that no single set joins, half-copies that share bands only, and rows without words."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    base, group = rng.choices(words, k=150), []
    for i in range(2000):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(150)] = rng.choice(words)
        group.append((3 * i + 1, " ".join(t)))
    group += [(10_000 + i, " ".join(base[:90] + rng.choices(words, k=60))) for i in range(100)] + [(5, None), (6, ""), (-1, "one two"), (-2, "One  two")]
    docs = spark.createDataFrame(group, "doc_id long, text string").repartition(4)
    assert fingerprints.similar_pairs(docs).count() < 4 * len(group)
    sets = sets_of(group, 5)
    want, copies = classes({i: s for i, s in sets.items() if i > 9_999 or i < 1 or i % 300 == 1}), dict(got(fingerprints.similar_groups(docs), "doc_id", "component_id"))
    assert all(copies.get(i, i) == 1 for i in range(1, 6001, 3)) and all(copies.get(i, i) == want[i] for i in want)
    assert 5 not in copies and 6 not in copies


def test_groups_of_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    found = dict(got(fingerprints.similar_groups(odd), "doc_id", "component_id"))
    assert None not in found and set(found) <= {i for i, _ in rows}
    assert fingerprints.similar_groups(none).collect() == [] and fingerprints.similar_pairs(none).collect() == []
    twice = spark.createDataFrame([(4, "a b c d e f g"), (4, "a b c d e f g"), (9, "a b c d e f g"), (None, "a b c d e f g")], "doc_id long, text string")
    assert got(fingerprints.similar_pairs(twice), "a", "b") == [(9, 4)]


# ---------------------------------------------------------------- 5 benchmark

@pytest.fixture(scope="module")
def items(spark, rows):
    texts = [" ".join((rows[8][1] or "").split()[5:30]), "KA-ta", "", None, "never seen words " * 6, "one two", " ".join((rows[2][1] or "x").split()[:13])]
    out = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[5])]
    return out, spark.createDataFrame(out, "item_id long, text string")


@pytest.mark.parametrize("window", [13, 4])
@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_benchmark_words_are_hit(docs, rows, items, window, block_bytes):
    windows = collections.defaultdict(set)
    for i, t in items[0]:
        w = TERM.findall(low(t or ""))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k:k + n])].add(i)
    want = []
    for r in rows:
        w, hit, named = TERM.findall(low(r[1] or "")), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    named |= windows[tuple(w[k:k + n])]
        ids = sorted(str(i) for i in named if i is not None)
        want.append((r[0], len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit) and 20 * len(hit) >= len(w)))
    out = decontaminate.contamination(docs, items[1], window, block_bytes=block_bytes)
    assert got(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=str)
    bad = {w[0] for w in want if w[5]}
    left = decontaminate.clean(docs, items[1], window)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r[0] for r in rows} - bad


def test_longest_matches(docs, rows, items):
    best = {(r.item_id, r.item_word): r.n_words for r in decontaminate.longest_matches(docs, items[1]).where("item_id = '0'").collect()}
    texts = ["|" + "|".join(TERM.findall(low(r[1] or ""))) + "|" for r in rows]
    words = TERM.findall(low(items[0][0][1]))
    for k in range(len(words)):
        n = max(n for n in range(len(words) - k + 1) if any("|" + "|".join(words[k:k + n]) + "|" in t for t in texts) or n == 0)
        assert best.get(("0", k), 0) == n


def test_benchmark_of_odd_rows(spark, odd, none, docs, items):
    for block in (1 << 20, 60):
        assert decontaminate.contamination(odd, items[1], block_bytes=block).count() == odd.count()
    assert decontaminate.contamination(none, items[1]).collect() == []
    assert decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0


# ---------------------------------------------------------------- 6 near copies

@pytest.mark.parametrize("size", [2, 5])
def test_components_are_those_of_all_pairs(docs, rows, size):
    sets = sets_of(rows, size)
    want = [(i, len(sets[i]), c, c == i) for i, c in classes(sets).items()]
    assert got(near_dedup.near_duplicates(docs, size), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=str)


def test_a_big_group_of_near_copies(spark):
    """Hundreds of near copies, and hundreds of texts that are alike but below the threshold: the nodes must branch."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(200):
        words = list(base)
        for k in rng.sample(range(120), 3):
            words[k] = f"e{i}_{k}"
        rows.append((i, " ".join(words)))
    for i in range(200, 330):
        rows.append((i, " ".join(f"t{k}" if k < 78 else f"u{i}_{k}" for k in range(110))))
    sets = sets_of(rows, 2)
    want = [(i, c) for i, c in classes(sets).items()]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2)
    assert got(out, "doc_id", "component_id") == sorted(want, key=str)


def test_near_copies_of_odd_rows(odd, docs, rows, none):
    out = near_dedup.near_duplicates(odd, 5)
    assert out.count() == odd.count()
    assert near_dedup.near_duplicates(none).collect() == []
    left = near_dedup.keep_one(odd, 5)
    assert left.columns == odd.columns
    want = {i for i, c in classes(sets_of(rows, 5)).items() if c == i}
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == sorted(want)


def test_components_of_a_long_path(spark):
    n = 200
    path = spark.createDataFrame([((i * 37) % n, ((i + 1) * 37) % n) for i in range(n - 1)] + [(1000, 1001), (7, 7)], "a long, b long")
    found = {r.id: r.root for r in components(path, Scratch(spark)).collect()}
    assert all(found[i] == 0 for i in range(n)) and found[1000] == found[1001] == 1000


# ---------------------------------------------------------------- 7 archives

@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x.org/{i}?q=a%20b", h) for i, h in enumerate(["<p>a</p>", "<p>a</p>", "", None, "ü\r\n\r\nWARC/1.1\r\n" * 9, "z" * 200000, "<p>a</p>"])] + [(9, None, "tail"), (None, "http://n", "<p>a</p>")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("least", [0, 1, 9])
def test_archives_come_back(spark, pages, least):
    first, want = {}, []
    for i, _, h in sorted(pages[0], key=lambda r: (r[0] is None, r[0] or 0)):
        h = h or ""
        again = h in first and len(h.encode()) >= least
        first.setdefault(h, i)
        want.append((i, len(h.encode()), warc.payload_digest(h), "revisit" if again else "response", first[h] if again else None))
    out = warc.round_trip(pages[1], Scratch(spark).path(), min_bytes=least)
    assert got(out, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=str)


def test_archive_filters_and_payloads(spark, pages, monkeypatch):
    path = Scratch(spark).path()
    back = warc.write_archives(pages[1].repartition(2), path)
    assert got(back.where("record_type = 'response'"), "page_id", "payload") == got(spark.createDataFrame([(i, h or "") for i, _, h in pages[0] if i in (0, 2, 4, 5, 9)], "page_id long, payload string"), "page_id", "payload")
    assert got(back.where("page_id in (4, 9)"), "page_id", "target_uri") == [(4, "http://x.org/4?q=a%20b"), (9, None)]
    assert [r.page_id for r in back.where("page_id > 8 and target_uri is null").collect()] == [9]
    reader = warc.WarcReader({"path": path})
    reader.wanted = {"record_type": {"revisit"}}
    monkeypatch.setattr(warc.zlib, "decompressobj", (lambda make: lambda *a: Opener(make(*a)))(warc.zlib.decompressobj))
    Opener.bytes = 0
    n = sum(len(list(reader.read(p))) for p in reader.partitions())
    assert n == 4 and Opener.bytes < 60000  # 200,000 of them are payloads not asked for


class Opener:
    bytes = 0

    def __init__(self, real):
        self.real = real

    def __getattr__(self, name):
        return getattr(self.real, name)

    def decompress(self, *a):
        out = self.real.decompress(*a)
        Opener.bytes += len(out)
        return out


def test_plain_and_foreign_archives(spark, tmp_path):
    import gzip
    a, b = (warc.record({"record_type": t, "payload": "body " + t, "page_id": i, "record_id": "<x>"}) for i, t in enumerate(["response", "metadata"]))
    (tmp_path / "one.warc").write_bytes(a + b)
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(a) + gzip.compress(b))
    warc.register(spark)
    out = spark.read.format("warc").load(str(tmp_path))
    assert got(out, "record_type", "payload") == sorted([("response", "body response"), ("metadata", "body metadata")] * 2, key=str)
    assert out.where("record_type = 'metadata'").count() == 2


def test_archives_are_appended_and_overwritten(spark, tmp_path):
    warc.register(spark)
    path = str(tmp_path / "w")
    rows = lambda lo, hi: spark.range(lo, hi).select("id", F.concat(F.lit("<html>"), "id").alias("html")).withColumnRenamed("id", "page_id").withColumn(
        "url", F.lit("http://x/"))
    ids = lambda: sorted(r.page_id for r in spark.read.format("warc").load(path).select("page_id").collect())

    def put(lo, hi, mode):
        warc.to_records(rows(lo, hi)).write.format("warc").mode(mode).save(path)

    put(0, 5, "append")
    put(5, 8, "append")
    assert ids() == list(range(8))
    put(20, 22, "append")
    assert ids() == [*range(8), 20, 21]
    put(30, 33, "overwrite")
    assert ids() == [30, 31, 32]
    put(40, 41, "append")
    assert ids() == [30, 31, 32, 40]
    assert len([f for f in os.listdir(path) if f.startswith("_archives-")]) == 2


def test_stray_line_ends_and_garbage(spark, tmp_path):
    a, b = (warc.record({"record_type": t, "payload": "body " + t, "page_id": i, "record_id": "<x>"}) for i, t in enumerate(["response", "metadata"]))
    warc.register(spark)
    (tmp_path / "one.warc").write_bytes(b"\r\n" + a + b"\r\n\r\n\n" + b + b"\r\n")
    assert sorted(r.record_type for r in spark.read.format("warc").load(str(tmp_path)).collect()) == ["metadata", "response"]
    (tmp_path / "one.warc").write_bytes(a + b"no record\r\n\r\n" + b)
    with pytest.raises(Exception, match="no WARC record"):
        spark.read.format("warc").load(str(tmp_path)).collect()


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"), Scratch(spark).path()).collect() == []


# ---------------------------------------------------------------- 8 chat

TALKS = [(1, 0, "system", "be </s> \\ kind"), (1, 1, "user", "[INST] a [/INST]\\"), (1, 2, "assistant", "</s>[INST] ok [/INST]"), (1, 3, "user", None), (1, 4, "assistant", "\\\\</s>"),
         (2, 0, "user", "only"), (3, 0, "assistant", ""), (3, 1, "assistant", "\n</s\n>"), (4, None, None, None), (4, 1, "tool\n<s>", "x"), (None, 0, "assistant", "free"),
         (5, 1, "assistant", "tie"), (5, 1, "assistant", "tie"), (5, 1, "assistant", "a"), (6, 0, "user", "\\" * 50000 + "<s>"), (6, 1, "assistant", "<" * 50000)]


def test_chat_reads_back(spark):
    rows = spark.createDataFrame([(*r, "extra") for r in TALKS], "conv_id long, turn long, role string, text string, k string").repartition(3)
    want = []
    for c in {r[0] for r in TALKS}:
        turns = sorted(((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in TALKS if r[0] == c))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)))
    made = chat.format_conversations(rows)
    assert got(read_back(made), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted(want, key=str)
    examples = chat.expand(made).where("conv_id = 1").orderBy("turn").collect()
    assert [e.turn for e in examples] == [2, 4]
    assert examples[0].context.endswith("</s><s> assistant\n") and examples[0].reply == "\\</s>\\[INST] ok \\[/INST]"
    assert examples[1].context.startswith(examples[0].context + examples[0].reply)
    assert all(e.example == e.context + e.reply and e.example[e.loss_start:] == e.reply for e in examples)
    kept = chat.expand(made, keep=True).where("conv_id = 2").collect()
    assert [(e.turn, e.example, e.formatted) for e in kept] == [(None, None, "<s>[INST] user\nonly [/INST]</s>")]
    assert read_back(chat.format_conversations(rows.where("false"))).collect() == []


# ---------------------------------------------------------------- 9 toxicity

def toxic_rows(n=900, seed=3):
    """Toxic when an insult meets a group; either alone is not."""
    rng, out = random.Random(seed), []
    for i in range(n):
        words = [f"n{rng.randrange(200)}" for _ in range(rng.randrange(20, 60))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["fool"] * insult + ["they"] * group
        rng.shuffle(words)
        out.append((i, " ".join(words), int(insult and group)))
    return out


def test_pairs_of_terms_are_learned(spark):
    data = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(None, None), (5, "again"), (9000, "")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in data] + [(3, 0, "x"), (None, 1, "x"), (4, None, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).withColumn("held", toxicity.held_out())
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    truth = {i: y for i, _, y in data}
    seen = [(r.score, truth[r.doc_id]) for r in out.where("held and doc_id < 900").collect()]
    right = np.mean([(s >= 0.7) == bool(y) for s, y in seen])
    assert right > 0.95
    assert toxicity.keep_clean(docs, model).where("doc_id is null or doc_id = 9000").count() == 2
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out.where("doc_id is not null").collect())


def test_labels_of_the_held_out_are_not_read(spark):
    data = toxic_rows(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    flipped = [(i, y if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - y) for i, _, y in data]
    a, b = (toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in ([(i, y) for i, _, y in data], flipped))
    assert a.bias == b.bias and (a.term == b.term).all() and (a.weight == b.weight).all() and (a.vector == b.vector).all()


def test_without_labels(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, empty)
    assert toxicity.score(docs, model).where("score < 0.01").count() == docs.count()
    assert toxicity.keep_clean(docs, model).count() == docs.count()
    assert toxicity.score(none, model).collect() == []


# ---------------------------------------------------------------- 10 mixing

def test_targets_reshare():
    goal = mixing.targets({"a": 10, "b": 1000, None: 500, "c": 0})
    assert goal["a"] == 30 and goal["c"] == 0 and sum(goal.values()) == 1510
    assert 5 * goal["b"] == 2 * goal[None]
    assert mixing.targets({}) == {}


@pytest.mark.parametrize("cell_rows", [20000, 20])
def test_the_mix_meets_its_targets(spark, cell_rows, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", cell_rows)
    rng = random.Random(4)
    rows = [(i, " ".join(["word"] * rng.randrange(0, 40)), rng.choice(["s1", "s1", "s1", "s2", "s3", None])) for i in range(900)] + [(5000 + i, "a b c", "s1") for i in range(3)] + [(None, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = mixing.mixed(docs)
    again = mixing.mixed(docs.repartition(2))
    assert got(out, "doc_id", "taken") == got(again, "doc_id", "taken")
    assert got(out, "doc_id", "size") == sorted(((r[0], len((r[1] or "").split())) for r in rows), key=str)
    assert out.where("taken > 3 * size").count() == 0
    source = {r[0]: r[2] for r in rows}
    sums = collections.Counter()
    for r in out.collect():
        sums[source[r.doc_id]] += r.taken
    for r in out.collect():
        assert abs(sums[source[r.doc_id]] - r.target) <= 20.5
    mixed = mixing.mix(docs)
    assert got(mixed.groupBy("doc_id").count(), "doc_id", "count") == got(out.where("times > 0").select("doc_id", F.col("times").cast("long").alias("count")), "doc_id", "count")


def test_heavier_documents_come_first(spark):
    rows = [(i, ("abcde " if i % 2 else "x" * 60 + " ") * 20, "s1" if i < 2000 else "s2") for i in range(2400)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id < 2000")
    plain, odd_ = (out.where(f"doc_id % 2 = {k} and times = 1").count() for k in (1, 0))
    assert plain > 1.3 * odd_ > 0


def test_mix_of_odd_rows(odd, none):
    assert mixing.mixed(odd).count() == odd.count()
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix(none).collect() == [] and mixing.mixed(none).collect() == []


def test_window_hashes_depend_on_content_alone():
    words = np.random.default_rng(1).integers(1 << 60, size=500, dtype=np.uint64)
    a, b = FIRST.windows(words, 20), FIRST.windows(words[100:], 20)
    assert (a[100:] == b).all() and len(set(a.tolist())) == len(a)
