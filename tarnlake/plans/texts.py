"""Queries over texts: cleaning, structure, chunks, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.functions import sentences
from tarnlake.functions import text as T
from tarnlake.functions.registry import embedder, sentence_encoder
from tarnlake.functions.words import cuts_phrase_at_once, lexicon_hits_at_once
from tarnlake.operators.chunking import chunk_documents, pack_sentences
from tarnlake.operators.scoring import relevance
from tarnlake.session import table
from tarnlake.sources.files import with_format

#: A lexicon for the fixture's invented words, in place of the service's own.
LEXICON = [("the", 0.3), ("and", 0.2), ("tion", 0.15), ("und", 0.15)]
#: Terms of its own for phrase_cut_guard: a sentence ends with a full stop and loses the space after it.
BORDER_TERMS = ["ing.the", "tion.and", "ung.der", "er.die", "es.les", "os.las"]
SPACES = r"[\s\x{0085}\p{Z}]+"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("clean_md5"))


def clean_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.clean_text(F.col("html"), compose=False)).alias("clean_md5"))


def noisy_chunks(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.is_noisy(F.col("text")).alias("noisy"), T.word_count(F.col("text")).alias("words"), T.char_count(F.col("text"), "|").alias("pipes"))


def lexicon_score(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", relevance(F.col("text"), lexicon=LEXICON).alias("score"))


def lexicon_score_at_once(spark, sf_dir):
    """By one automaton for all words."""
    return _docs(spark, sf_dir).select("doc_id", relevance(F.col("text"), lexicon=LEXICON, hits=lexicon_hits_at_once).alias("score"))


def lexicon_score_with_model(spark, sf_dir):
    """The labels' quality stands for a model's topic score."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_id")
    rows = _docs(spark, sf_dir).join(labels, F.col("doc_id") == F.col("l_id"))
    return rows.select("doc_id", relevance(F.col("text"), F.col("quality") * F.lit(0.5), F.col("toxic") * F.lit(0.7), LEXICON).alias("score"))


def heading_split(spark, sf_dir):
    """Heading lines of each document, carried forward as the section of the lines after them: by arrays, a document is one row."""
    head = lambda line: T.is_txt_heading(line) & (F.trim(line) != "")
    lines = F.split("text", "\n")
    rows = _docs(spark, sf_dir).filter("text is not null").select("doc_id", lines.alias("lines")).select("doc_id", F.size("lines").cast("long").alias("n_lines"), T.sections(F.col("lines"), head).alias("s"))
    inside = lambda s: F.when(s["section"] != "Unknown", F.size(s["lines"])).otherwise(0).cast("long")
    headings = F.size(F.filter("s", lambda s: s["section"].isNotNull())).cast("long")
    return rows.select("doc_id", headings.alias("headings"), "n_lines", F.aggregate("s", F.lit(0).cast("long"), lambda n, s: n + inside(s)).alias("in_sections"))


def structure_blocks(spark, sf_dir):
    """Pages with their titles as headings and footers after page breaks, split into blocks."""
    marked = F.concat(F.lit("[HEADING]"), "url", F.lit("[/HEADING] first part [PAGE_BREAK]  [PAGE_BREAK]\n a [HEADING]x [1] y[/HEADING] z[PAGE_BREAK][HEADING]x [1] y[/HEADING]\nz[PAGE_BREAK]second "), F.col("page_id").cast("string"))
    b = table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.blocks(marked)).alias("pos", "b"))
    return b.select("page_id", "pos", "b.kind", "b.content")


def sentence_counts(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "\n")).alias("joined_md5"))


def abbreviation_scores(spark, sf_dir):
    """How much like an abbreviation each word with a full stop is."""
    words = sentences.scored(sentences.dotted_words(_docs(spark, sf_dir))).filter("dotted > 0")
    return words.select("word", "n", "dotted", (F.round("score", 4) + 0.0).alias("score"))


def greedy_chunks(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("s", T.sentences(F.col("text")))
    return d.select("doc_id", F.posexplode(pack_sentences(F.col("s"), 120, 20)).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.words", "c.sentences")


def semantic_chunks(spark, sf_dir):
    """With the service's limits; hash_vector stands for its model."""
    return chunk_documents(_docs(spark, sf_dir), load=sentence_encoder, min_tokens=50, threshold=0.7).select("doc_id", "chunk_index", "word_count", "section", F.md5("content").alias("content_md5"))


def sentence_borders(df, terms, *keys, cuts=T.cuts_phrase):
    """Whether the border after each sentence but a text's last cuts a term; pos counts from 0."""
    s = T.sentences(F.col("text"))
    rows = df.select(*keys, s.alias("s")).filter(F.size("s") > 1)
    pairs = F.arrays_zip(F.slice("s", 1, F.size("s") - 1).alias("before"), F.slice("s", 2, F.size("s") - 1).alias("after"))
    return rows.select(*keys, F.posexplode(pairs).alias("pos", "p")).select(*keys, "pos", cuts(F.col("p.before"), F.col("p.after"), terms).alias("cut"))


def phrase_cut_guard(spark, sf_dir):
    """At each border between neighbouring sentences of whole messages."""
    return sentence_borders(table(spark, sf_dir, "conversations"), BORDER_TERMS, "conv_id", "turn")


def phrase_cuts_at_once(spark, sf_dir):
    """By lookups of what the sentences end with."""
    return sentence_borders(table(spark, sf_dir, "conversations"), BORDER_TERMS, "conv_id", "turn", cuts=cuts_phrase_at_once)


def path_parts(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    return p.select("page_id", T.bucket_of(F.col("path")).alias("bucket"), T.object_of(F.col("path")).alias("object"), T.base_name(F.col("path")).alias("base"))


def format_dispatch(spark, sf_dir):
    kinds = F.array(*map(F.lit, [".TXT", ".pdf", ".docx?v=1", ".exe#x", ""]))
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("f"), F.col("page_id").cast("string"), F.get(kinds, (F.col("page_id") % 5).cast("int"))).alias("path"))
    return with_format(p).select("page_id", "path", "extension")


def compressible(spark, sf_dir):
    kinds = F.array(*map(F.lit, [".txt", ".pdf", ".html", ".JSON", ""]))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.get(kinds, (F.col("doc_id") % 5).cast("int")))
    d = table(spark, sf_dir, "documents").withColumn("name", name)
    return d.select("doc_id", T.should_compress(F.col("name"), F.col("n_chars")).alias("compress"), T.best_compression(F.when(F.col("doc_id") % 2 == 0, "gzip, deflate").otherwise("gzip, br"), "brotli").alias("encoding"))


def table_markdown(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    t = F.array(F.array(F.lit("key"), F.lit("name")), F.array(F.col("n_nationkey").cast("string"), F.col("n_name")))
    text = F.concat(F.lit("a [TABLE] b [TABLE] "), "n_name")
    return n.select("n_nationkey", T.table_markdown(t).alias("markdown"), T.inject_tables(text, F.array(t)).alias("injected"))


#: Pages as marked text: headings, and page breaks where a navigation or a footer begins.
MARKS = [("<h1>", "[HEADING]"), ("</h1>", "[/HEADING]"), ("<(nav|footer)>", "[PAGE_BREAK]"), ("<[^>]*>", " ")]


def page_blocks(spark, sf_dir):
    marked = F.col("html")
    for pattern, new in MARKS:
        marked = F.regexp_replace(marked, pattern, new)
    b = table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.blocks(marked)).alias("pos", "b"))
    return b.select("page_id", "pos", "b.kind", "b.content")


LINK = '<a href="([^"]*)">([^<]*)</a>'


def page_tables(spark, sf_dir):
    """Each page's links as a table; by their numbers, pages have none, an empty header, an empty row, a null cell, or all."""
    links = [F.regexp_extract_all("html", F.lit(LINK), F.lit(i)) for i in (1, 2)]
    rows = F.zip_with(*links, lambda a, b: F.array(a, b))
    none, other = F.array().cast("array<string>"), F.array(F.array(F.lit("link"), F.lit(None).cast("string")))
    k = F.pmod("page_id", F.lit(5))
    t = F.when(k == 0, F.slice(rows, 1, 0)).when(k == 1, F.concat(F.array(none), rows)).when(k == 2, F.concat(F.slice(rows, 1, 1), F.array(none), rows)).when(k == 3, F.concat(rows, other)).otherwise(rows)
    text = F.concat(F.lit("a [TABLE] b [TABLE] "), "url")
    return table(spark, sf_dir, "pages").select("page_id", T.table_markdown(t).alias("markdown"), T.inject_tables(text, F.array(t)).alias("injected"))


def embed_texts(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("v", embedder(size=64)(F.col("text")))
    return d.select("doc_id", F.size("v").alias("dimensions"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x), 3).alias("length"))


def answer_guard(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return c.select("conv_id", "turn", F.md5(T.guard_answer(F.col("text"))).alias("answer_md5"))


CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, 'https?://[^\\s\\x{{0085}}\\p{{Z}}]+', '', 'g'), '\\p{{Nd}}{{1,2}}:\\p{{Nd}}{{2}} [AP]M.*?Wikipedia', '', 'g'), '\\[[\\s\\p{{Z}}]*\\p{{Nd}}+[\\s\\p{{Z}}]*\\]', '', 'g'), '/\\p{{Nd}}{{1,3}},?[\\s\\p{{Z}}]*\\p{{Nd}}{{1,2}}:\\p{{Nd}}{{2}}', '', 'g'), '([\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+)-\\n([\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+)', '\\1\\2', 'g'), '([a-z])\\n([a-z])', '\\1 \\2', 'g')"
FLAT = f"trim(regexp_replace(text, '{SPACES}', ' ', 'g'))"
WORDS = f"len(list_filter(regexp_split_to_array(text, '{SPACES}'), lambda w: w <> ''))"
PIPES = "(length(text) - length(replace(text, '|', '')))"
SENTENCES = f"list_filter(string_split(regexp_replace({FLAT}, '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 3)"


def _score_sql(source: str, topic: str, side: str) -> str:
    """The lexicon rule with a negation anywhere in the 100 characters before a term's first occurrence."""
    negated = " OR ".join(f"contains(b{{0}}, '{n}')" for n in ["not", "no", "non-", "without", "never", "rarely", "không", "chưa", "chẳng"])
    before = ", ".join(f"substr(low, greatest(strpos(low, '{t}') - 100, 1), least(strpos(low, '{t}') - 1, 100)) AS b{i}" for i, (t, _) in enumerate(LEXICON))
    hit = [f"(contains(low, '{t}') AND NOT ({negated.format(i)}))" for i, (t, _) in enumerate(LEXICON)]
    count = " + ".join(f"CASE WHEN {h} THEN 1 ELSE 0 END" for h in hit)
    weight = " + ".join(f"CASE WHEN {h} THEN {w}::DOUBLE ELSE 0 END" for h, (_, w) in zip(hit, LEXICON, strict=True))
    return f"""WITH l AS (SELECT doc_id, text, lower(text) AS low, ({topic})::DOUBLE AS d, ({side})::DOUBLE AS side FROM {source}), b AS (SELECT *, {before} FROM l),
s AS (SELECT doc_id, text, d, side, {count} AS c, {weight} AS w FROM b)
SELECT doc_id, round(CASE WHEN trim(text) = '' THEN 0.0 WHEN side > 0.6 THEN 0.0 WHEN d < 0.3 AND c = 0 THEN 0.0 WHEN c >= 3 THEN least(0.4 + w, 1.0)
WHEN c >= 2 AND d > 0.25 THEN least(d + 0.3 + w, 0.9) WHEN c >= 1 AND d > 0.4 THEN least(d + 0.25 + w, 0.8) ELSE greatest(d * 0.7, w * 0.8) END::DOUBLE, 3) AS score FROM s"""


HEAD = "CASE WHEN ((length(line) < 100 AND line = upper(line)) OR ends_with(line, ':')) AND trim(line) <> '' THEN line END"
LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"

PB = "''"

MARKED = "html"
for _old, _new in MARKS:
    MARKED = f"regexp_replace({MARKED}, '{_old}', '{_new}', 'g')"

ENTRIES = {
    "clean_text": (clean_text, f"SELECT doc_id, md5(trim(regexp_replace({CLEAN.format('nfc_normalize(text)')}, '{SPACES}', ' ', 'g'))) AS clean_md5 FROM documents"),
    "clean_pages": (clean_pages, f"SELECT page_id, md5(trim(regexp_replace({CLEAN.format('html')}, '{SPACES}', ' ', 'g'))) AS clean_md5 FROM pages"),
    "noisy_chunks": (noisy_chunks, f"SELECT doc_id, {WORDS} < 10 OR {PIPES} / ({WORDS} + 1) > 0.3 OR (contains(text, 'Wikipedia') AND NOT contains(text, '://')) AS noisy, {WORDS} AS words, {PIPES} AS pipes FROM documents"),
    "lexicon_score_at_once": (lexicon_score_at_once, _score_sql("documents", "0", "0")),
    "lexicon_score": (lexicon_score, _score_sql("documents", "0", "0")),
    "lexicon_score_with_model": (lexicon_score_with_model, _score_sql("documents JOIN labels USING (doc_id)", "quality * 0.5", "toxic * 0.7")),
    "heading_split": (heading_split, f"WITH {LINES}, h AS (SELECT *, {HEAD} AS head FROM l), s AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM h) SELECT doc_id, count(head) AS headings, count(*) AS n_lines, count(*) FILTER (WHERE coalesce(section, 'Unknown') <> 'Unknown') AS in_sections FROM s GROUP BY doc_id"),
    "structure_blocks": (structure_blocks, f"SELECT page_id, unnest(range(9))::INT AS pos, unnest(['heading', 'paragraph', 'page_break', 'page_break', 'paragraph', 'page_break', 'heading', 'page_break', 'paragraph']) AS kind, unnest([url, 'first part', {PB}, {PB}, 'a [HEADING]x [1] y[/HEADING] z', {PB}, 'x [1] y' || chr(10) || 'z', {PB}, 'second ' || page_id]) AS content FROM pages"),
    "sentence_counts": (sentence_counts, f"SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS joined_md5 FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)"),
    "abbreviation_scores": (abbreviation_scores, r"""WITH t AS (SELECT regexp_replace(unnest(regexp_split_to_array(text, '\s+')), '^[(\[{]+', '') AS t FROM documents), w AS (SELECT lower(regexp_replace(t, '\.$', '')) AS word, ends_with(t, '.') AS dot FROM t),
c AS (SELECT word, count(*) AS n, count(*) FILTER (WHERE dot) AS dotted FROM w WHERE regexp_full_match(word, '\pL+(\.\pL+)*') GROUP BY word), p AS (SELECT sum(dotted)::DOUBLE / sum(n) AS p FROM c)
SELECT word, n, dotted, round(2 * ((dotted * ln(0.99) + (n - dotted) * ln(1 - 0.99)) - (dotted * ln(p) + (n - dotted) * ln(1 - p))) * exp(-length(replace(word, '.', ''))::DOUBLE) * (length(word) - length(replace(word, '.', '')) + 1) * pow(length(replace(word, '.', '')), dotted - n), 4) + 0.0 AS score FROM c, p WHERE dotted > 0"""),
    "greedy_chunks": (greedy_chunks, f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_transform({SENTENCES}, lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> ''))) AS n FROM documents),
f AS (SELECT doc_id, n, 1 AS i, 0 AS idx, 0::BIGINT AS words, 0 AS sentences, NULL::BIGINT AS out_words, NULL::INT AS out_sentences, 0 AS out_idx FROM d
UNION ALL SELECT doc_id, n, i + 1, CASE WHEN closed THEN idx + 1 ELSE idx END, CASE WHEN closed THEN x ELSE words + x END, CASE WHEN closed THEN 1 ELSE sentences + 1 END, CASE WHEN closed THEN words END, CASE WHEN closed THEN sentences END, idx
FROM (SELECT *, CASE WHEN i <= len(n) THEN n[i] ELSE 0 END AS x, (i > len(n) AND sentences > 0 AND words >= 20) OR (i <= len(n) AND words + n[i] > 120 AND words >= 20) AS closed FROM f WHERE i <= len(n) + 1))
SELECT doc_id, out_idx AS chunk_index, out_words AS words, out_sentences AS sentences FROM f WHERE out_words IS NOT NULL"""),
    "semantic_chunks": (semantic_chunks, None),
    "phrase_cut_guard": (phrase_cut_guard, f"WITH t AS (SELECT unnest({BORDER_TERMS}) AS term), p AS (SELECT term, unnest(range(3, length(term) - 2)) AS i FROM t), d AS (SELECT conv_id, turn, list_transform({SENTENCES}, lambda x: trim(x)) AS s FROM conversations), b AS (SELECT conv_id, turn, s, unnest(range(len(s) - 1)) AS pos FROM d), c AS (SELECT conv_id, turn, pos, lower(s[pos + 1]) AS a, lower(s[pos + 2]) AS z FROM b) SELECT conv_id, turn, pos::INT AS pos, (SELECT coalesce(bool_or(ends_with(c.a, substr(term, 1, i)) AND starts_with(c.z, substr(term, i + 1))), false) FROM p) AS cut FROM c"),
    "path_parts": (path_parts, "WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages) SELECT page_id, string_split(path, '/')[1] AS bucket, CASE WHEN contains(path, '/') THEN substr(path, strpos(path, '/') + 1) ELSE '' END AS object, string_split(path, '/')[-1] AS base FROM p"),
    "format_dispatch": (format_dispatch, "WITH p AS (SELECT page_id, 'f' || page_id || ['.TXT', '.pdf', '.docx?v=1', '.exe#x', ''][(page_id % 5 + 1)::INT] AS path FROM pages) SELECT page_id, path, lower(regexp_extract(path, '(\\.[^.?#/]+)(?:[?#].*)?$', 1)) AS extension FROM p"),
    "compressible": (compressible, "WITH d AS (SELECT doc_id, n_chars, ['.txt', '.pdf', '.html', '.JSON', ''][(doc_id % 5 + 1)::INT] AS e FROM documents) SELECT doc_id, n_chars BETWEEN 1024 AND 104857600 AND lower(e) IN ('.txt', '.html', '.json') AS compress, CASE WHEN doc_id % 2 = 0 THEN 'gzip' ELSE 'br' END AS encoding FROM d"),
    "table_markdown": (table_markdown, "WITH n AS (SELECT n_nationkey, n_name, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_nationkey || ' | ' || n_name || ' |' AS markdown FROM nation) SELECT n_nationkey, markdown, 'a ' || markdown || ' b [TABLE] ' || n_name AS injected FROM n"),
    "page_blocks": (page_blocks, f"""WITH p AS (SELECT page_id, {MARKED} AS t FROM pages), b AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(t, '(\\[PAGE_BREAK\\]|\\[HEADING\\][^\\[]*\\[/HEADING\\])', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS b FROM p),
e AS (SELECT page_id, unnest(range(len(b))) AS i, unnest(b) AS x FROM b) SELECT page_id, i::INT AS pos, CASE WHEN x = '[PAGE_BREAK]' THEN 'page_break' WHEN starts_with(x, '[HEADING]') THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN x = '[PAGE_BREAK]' THEN '' WHEN starts_with(x, '[HEADING]') THEN trim(regexp_replace(x, '\\[/?HEADING\\]', '', 'g')) ELSE x END AS content FROM e"""),
    "page_tables": (page_tables, f"""WITH l AS (SELECT page_id, url, list_transform(list_zip(regexp_extract_all(html, '{LINK}', 1), regexp_extract_all(html, '{LINK}', 2)), lambda x: [x[1], x[2]]) AS r FROM pages),
t AS (SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN [] WHEN 1 THEN list_concat([[]], r) WHEN 2 THEN list_concat(r[1:1], [[]], r) WHEN 3 THEN list_concat(r, [['link', NULL]]) ELSE r END::VARCHAR[][] AS t FROM l),
m AS (SELECT page_id, url, CASE WHEN len(t) = 0 OR len(t[1]) = 0 THEN '' WHEN len(list_filter(flatten(t), lambda x: x IS NULL)) > 0 THEN '[BẢNG]' ELSE array_to_string(list_concat(['| ' || t[1][1] || ' | ' || t[1][2] || ' |', '| --- | --- |'], list_transform(list_filter(t[2:], lambda x: len(x) > 0), lambda x: '| ' || x[1] || ' | ' || x[2] || ' |')), chr(10)) END AS markdown FROM t)
SELECT page_id, markdown, 'a ' || markdown || ' b [TABLE] ' || url AS injected FROM m"""),
    "embed_texts": (embed_texts, None),
    "answer_guard": (answer_guard, None),
}
ENTRIES["phrase_cuts_at_once"] = (phrase_cuts_at_once, ENTRIES["phrase_cut_guard"][1])
