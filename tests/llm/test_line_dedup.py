from collections import Counter

from tests.llm.cases import awkward, documents

from tarnlake.llm.line_dedup import line_dedup


def brute(rows, size=3):
    first, out = {}, []
    place = lambda i, p: (i is None, i or 0, p)
    for r in rows:
        lines = (r.text or "").split("\n")
        for p in range(len(lines) - size + 1):
            key = tuple(lines[p : p + size])
            first[key] = min(first.get(key, place(r.doc_id, p)), place(r.doc_id, p))
    for r in rows:
        if r.text is None:
            out.append((str(r.doc_id), 0, 0, None))
            continue
        lines = r.text.split("\n")
        keep = [True] * len(lines)
        for p in range(len(lines) - size + 1):
            if place(r.doc_id, p) > first[tuple(lines[p : p + size])]:
                keep[p : p + size] = [False] * size
        kept = [x for x, k in zip(lines, keep) if k]
        out.append((str(r.doc_id), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def result(df):
    return Counter((str(r.doc_id), r.n_lines, r.n_removed, r.text) for r in df.collect())


def test_against_brute_force(spark, sf_small):
    few = [(i, "\n".join("abc"[(i * j * j + j) % 3] for j in range(i % 9))) for i in range(200)]
    for docs in (awkward(documents(spark)), spark.read.parquet(f"{sf_small}/documents.parquet"), documents(spark, few)):
        assert result(line_dedup(docs)) == brute(docs.collect())


def test_columns_stay(spark):
    docs = awkward(documents(spark, [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny")])).withColumnRenamed("grp", "n_removed")
    out = line_dedup(docs)
    assert set(out.columns) == {*docs.columns, "n_lines"}
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[2].text == "x\ny" and rows[2].n_chars == 3 and rows[2].n_removed == 3 and rows[1].n_removed == 0 and rows[1].norm == 1
    assert line_dedup(documents(spark, [])).count() == 0


def test_hot_window(spark):
    docs = documents(spark, [(i, f"{i}\nsame\nlines\nhere\n{-i}") for i in range(3000)])
    rows = line_dedup(docs).collect()
    assert sum(r.n_removed for r in rows) == 3 * 2999 and next(r for r in rows if r.doc_id == 0).n_removed == 0
