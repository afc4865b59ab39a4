"""The pipeline's stages against plain Python on planted rows, and on odd rows."""
import random
import re
from collections import Counter

import corpus_pipeline as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def planted(seed=5):
    """(documents, labels, benchmark items); the last documents are odd."""
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    items = [(i, " ".join(words(30))) for i in range(4)]
    texts, toxic = [], set()
    for i in range(420):
        kind, t = i % 14, words(rng.randrange(60, 120))
        if kind in (0, 1, 2):  # toxic
            t[rng.randrange(len(t))] = "vilegarb"
            t[rng.randrange(len(t))] = "crudslur"
            toxic.add(i)
        elif kind == 5:  # a near copy of the clean document before it
            t = texts[-1].split(" ")
            t[rng.randrange(len(t))] = "changed"
        elif kind == 6:  # an exact copy
            t = texts[-2].split(" ")
        elif kind == 9:  # holds most of an item
            t[20:20] = items[i % 4][1].upper().split(" ")[:25]
        elif kind == 10:  # a stray piece of an item, shorter than a window
            t[20:20] = items[i % 4][1].split(" ")[:12]
        texts.append(" ".join(t))
    docs = [(i, t, "en", f"src{i % 3}" if i % 3 else "big", len(t)) for i, t in enumerate(texts)]
    odd = [(9000, None, None, None, None), (9001, "", "en", "src1", 0), (9002, " \n\t", "en", None, 3), (9003, "one", "en", "big", 3), (9004, "xyz " * 20000, "en", "src2", 80000)]
    labels = [(d[0], 1, int(d[0] in toxic)) for d in docs]
    return docs + odd + [docs[3], odd[0]], labels, items, toxic


def near_classes(rows):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def contaminated(text, items):
    low = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = {tuple(w[k:k + 13]) for w in (low(t) for _, t in items) for k in range(len(w) - 12)}
    w, hit = low(text), set()
    for k in range(len(w) - 12):
        if tuple(w[k:k + 13]) in windows:
            hit |= set(range(k, k + 13))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_each_stage_does_its_work(spark, tmp_path):
    docs, labels, items, toxic = planted()
    at = str(tmp_path)
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    kept, now = {}, spark.read.parquet(f"{at}/documents.parquet")
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, now, at).write.parquet(f"{at}/out{i}")
        now = spark.read.parquet(f"{at}/out{i}")
        if name != "sharding":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = [tuple(r) for r in now.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert Counter(r[0] for r in kept["toxicity"]) == Counter(d[0] for d in docs if d[0] not in toxic)
    leader = near_classes(kept["toxicity"])
    want = Counter(i for i in leader if leader[i] == i)
    got = Counter(r[0] for r in kept["near_dedup"])
    assert set(got) == set(want) and all(got[i] == 1 for i in got if i < 9000) and len(got) < len(leader) - 50
    clean = [r for r in kept["near_dedup"] if not contaminated(r[1], items)]
    assert Counter(kept["decontamination"]) == Counter(clean) and len(clean) < len(kept["near_dedup"]) - 20
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in clean}
    taken, source = Counter(), {r[0]: r[3] for r in clean}
    for r in kept["mixing"]:
        taken[r[0]] += 1
        assert r in clean
    assert max(taken.values()) <= 4  # three times its size; a text without words may go along
    assert all(n <= 3 for i, n in taken.items() if size[i])
    total, had, took = sum(size.values()), Counter(), Counter()
    for i, n in size.items():
        had[source[i]] += n
        took[source[i]] += n * taken[i]
    weights = dict(zip(sorted(s for s in had if s is not None), (5, 2, 1)))
    target, left, free = {}, float(total), dict(weights)  # sources at three times their size leave the excess to the others
    while free:
        full = [s for s in free if left * free[s] / sum(free.values()) > 3 * had[s]]
        target |= {s: 3.0 * had[s] for s in full} if full else {s: left * free[s] / sum(free.values()) for s in free}
        left, free = left - sum(3 * had[s] for s in full), {s: free[s] for s in free if full and s not in full}
    for s in weights:
        longest = max(n for i, n in size.items() if source[i] == s)
        assert abs(took[s] - target[s]) <= longest, (s, took[s], target[s])
    assert Counter(kept["sharding"]) == Counter(kept["mixing"])
    again = Counter(tuple(r) for r in P.run(spark, at).select("doc_id", "text", "lang", "source", "n_chars").collect())
    assert again == Counter(kept["sharding"])


def test_empty_tables(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    assert P.run(spark, at).count() == 0
