from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers

import corpus_pipeline
from lumenspan.llm import langid, lines, pieces, shared, simhash
from tests.llm import test_decontam, test_simhash


def without_boilerplate(docs):
    """Line dedup with near-equal pages counted once, in plain Python."""
    prints = [test_simhash.brute_fingerprint(t, corpus_pipeline.SHINGLE_WORDS) for _, t, _, _ in docs]
    page = test_simhash.brute_components(list(enumerate(prints)), lines.NEAR_BITS)
    pages, held = defaultdict(set), defaultdict(set)
    for (_, text, _, host), p in zip(docs, page, strict=True):
        pages[host].add(p)
        for line in set(text.split("\n")):
            if line.strip(" "):
                held[host, line].add(p)
    bad = {k for k, v in held.items() if len(v) >= 3 and len(v) > 0.05 * len(pages[k[0]])}
    return [(i, "\n".join(x for x in t.split("\n") if (s, x) not in bad), lang, s) for i, t, lang, s in docs]


def brute(docs, benchmark, model):
    """The five stages in plain Python over (doc_id, text, lang, source) rows."""
    texts = [t for _, t, _, _ in docs]
    told = list(zip(*model.predict(texts), strict=True))
    docs = [(i, t, lang or p, s) for (i, t, lang, s), (p, score) in zip(docs, told, strict=True) if p != "und" and score >= corpus_pipeline.LEAST_SCORE]
    docs = without_boilerplate(docs)
    prints = [test_simhash.brute_fingerprint(t, corpus_pipeline.SHINGLE_WORDS) for _, t, _, _ in docs]
    sketches = [simhash.with_sketch((t or "").encode(), corpus_pipeline.SHINGLE_WORDS)[1] for _, t, _, _ in docs]
    sets = [set(simhash.shingles((t or "").encode(), corpus_pipeline.SHINGLE_WORDS).tolist()) for _, t, _, _ in docs]
    blocks = [x.view("u2") for x in sketches]
    connected, up = list(range(len(docs))), list(range(len(docs)))

    def root(up, i):
        while up[i] != i:
            i = up[i]
        return i

    def join(up, a, b):
        a, b = root(up, a), root(up, b)
        up[max(a, b)] = min(a, b)

    near = [p for p in combinations(range(len(docs)), 2) if int(np.bitwise_count(sketches[p[0]] ^ sketches[p[1]]).sum()) <= 128]
    for a, b in near:
        if (blocks[a] == blocks[b]).any():
            join(connected, a, b)
    for a, b in combinations(range(len(docs)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= corpus_pipeline.MOST_BITS:
            join(up, a, b)
    for a, b in near:
        if root(connected, a) == root(connected, b) and sets[a] and len(sets[a] & sets[b]) >= corpus_pipeline.LEAST_SIMILAR * len(sets[a] | sets[b]):
            join(up, a, b)
    groups = {}
    for k, d in enumerate(docs):
        groups.setdefault(root(up, k), []).append(d)
    docs = [min(g) for g in groups.values()]
    items = [tuple(r) for r in benchmark]
    marks = test_decontam.found([t for _, t, _, _ in docs], items)
    docs = [d for d, m in zip(docs, marks, strict=True) if not m[3]]
    own = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    return sorted((i, lang, s, own.encode(t).tolist()) for i, t, lang, s in docs)


def test_pipeline_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    want = brute(rows, benchmark, langid.train(docs))
    assert 0 < len(want) < len(rows)
    assert sorted((r.doc_id, r.lang, r.source, list(r.ids)) for r in got) == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_columns_and_odd_rows(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, "word " * 50_000, None, None, 1), (-2, "word " * 50_000, None, None, 1)], docs.schema)
    for table in (docs.union(odd), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, sf_dir)
            assert table.columns == docs.columns, name
        assert corpus_pipeline.encoding(spark, table, sf_dir).count() == table.count()


def test_a_stage_drops_what_came_before(spark):
    with shared.scope(spark):
        inner = shared.cut(spark.range(3), "inner")
        first = shared.cut(inner, "first", keep=True)
    assert first.count() == 3
    path = first.inputFiles()[0]
    with shared.scope(spark):
        second = shared.cut(first, "second", keep=True)
    assert second.count() == 3
    import os
    assert not os.path.exists(path.removeprefix("file://").replace("%20", " "))


def test_registered():
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 11))
