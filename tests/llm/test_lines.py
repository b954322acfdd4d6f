from collections import Counter, defaultdict

import duckdb
from lumenspan.llm import lines, queries
from tests.llm.test_simhash import brute_components, brute_fingerprint


def brute(rows):
    pages = defaultdict(list)
    for _, text, host in rows:
        if text is not None:
            pages[host].append(text)
    drop = {}
    for host, texts in pages.items():
        n = Counter(x for t in texts for x in set(t.split("\n")) if x.strip(" "))
        drop[host] = {x for x, k in n.items() if k >= 3 and k > 0.05 * len(texts)}
    out = []
    for i, text, host in rows:
        out.append((i, None if text is None else "\n".join(x for x in text.split("\n") if x not in drop[host]), host))
    return sorted(out, key=str)


def test_drop_boilerplate(spark, tmp_path):
    rows = [(i, f"All rights reserved\nstory number {i} {'goes on ' * i}\n\nfooter {i % 40}", f"h{i % 3}") for i in range(240)]
    rows += [(300 + i, "All rights reserved\nsame page\nsame page too", "copies") for i in range(20)]
    rows += [(400, None, "h1"), (401, "", "h1"), (402, "All rights reserved", "h1"), (403, "only page\nof host", "h9"), (404, "\n\n", None), (405, "a\n" * 50_000 + "tail", "h1")]
    rows += [(500 + i, f"null host line\nx{i} and more words", None) for i in range(5)] + [(None, rows[4][1], "h1"), (7, rows[7][1], "h1")]
    docs = spark.createDataFrame([(*r, 1, None, None) for r in rows], "doc_id long, text string, source string, n_chars int, host string, lines string")
    got = lines.drop_boilerplate(docs, length_col="n_chars")
    assert got.schema == docs.schema
    table = got.collect()
    assert sorted(((r.doc_id, r.text, r.source) for r in table), key=str) == brute(rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in table)
    texts = {r.doc_id: r.text for r in table}
    assert texts[3].startswith("story")
    assert texts[300] == texts[402] == ""  # copies are pages, and no text is spared
    salted = lines.drop_boilerplate(docs, length_col="n_chars", hot_pages=7, broadcast_lines=0, dropped_col="n_dropped").collect()
    assert sorted(((r.doc_id, r.text, r.source) for r in salted), key=str) == brute(rows)
    assert {r.doc_id: r.n_dropped for r in salted}[300] == 3
    assert lines.drop_boilerplate(docs.limit(0)).collect() == []
    docs.drop("host", "lines").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    own = queries.QUERIES["op2_lines"](spark, str(tmp_path))
    sql = con.execute(lines.ORACLE)
    names = [c[0] for c in sql.description]
    assert sorted(sql.fetchall(), key=str) == sorted((tuple(r[c] for c in names) for r in own.collect()), key=str)


#: Frequency by page number, and no text spared.
WHOLE = """
WITH totals AS (SELECT source, count(DISTINCT page) AS n FROM documents WHERE text IS NOT NULL GROUP BY source),
lines AS (SELECT DISTINCT source, page, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
often AS (
  SELECT l.source, l.line FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE trim(line) <> '' GROUP BY l.source, l.line, t.n HAVING count(*) >= 3 AND count(*) > 0.05::DOUBLE * t.n),
hosts AS (SELECT source, list(line) AS found FROM often GROUP BY source)
SELECT doc_id, CASE WHEN found IS NULL THEN text ELSE
  array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(found, x)), chr(10)) END
FROM documents d LEFT JOIN hosts h ON d.source IS NOT DISTINCT FROM h.source
"""


def test_thin_pages_lose_boilerplate_and_near_copies_count_once(spark):
    menu = "home news sport weather about us contact terms privacy cookies help"
    story = [" ".join(f"w{k}x{j}" for j in range(100)) for k in range(4)]
    rows = [(i, f"{menu}\n" + " ".join(f"a{i}b{j}" for j in range(4 + 9 * (i % 7))), "thin") for i in range(30)]
    rows += [(100 + i, "\n".join([*story, f"copy {i}"]), "few") for i in range(4)] + [(110, "lone page", "few"), (111, None, "few"), (112, "x y", None)]
    numbers = brute_components([(i, brute_fingerprint(t, 5)) for i, t, _ in rows], lines.NEAR_BITS)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR, page BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [(*r, n) for r, n in zip(rows, numbers, strict=True)])
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in lines.drop_boilerplate(docs, near_words=5).collect()}
    assert got == dict(con.execute(WHOLE).fetchall())
    assert not any(menu in got[i] for i in range(30))
    assert got[100] == rows[30][1]
