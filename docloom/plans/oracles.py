"""SQL twins of the catalogue's queries, for DuckDB."""

from __future__ import annotations

from docloom.functions.headings import LEGAL, NAMES
from docloom.functions.text import AUDIT_MARKERS, AUDIT_OPENINGS, FORM_MARKERS, STOPWORDS_EN, STOPWORDS_VI, VI_LETTERS, unaccented

SEP = r"[^\p{L}\p{N}_]+"
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"
CH = "ch AS (SELECT DISTINCT ON (chunk_id) * FROM chunks)"


def tok(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '{SEP}'), lambda x: x <> '')"


def long_tok(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '{SEP}'), lambda x: length(x) >= 2)"


def pairs(c: str) -> str:
    t = long_tok(c)
    return f"list_distinct(list_transform(range(1, greatest(len({t}), 1)), lambda i: ({t})[i] || ' ' || ({t})[i + 1]))"


def squash(c: str) -> str:
    return f"trim(regexp_replace({c}, '{BLANK}', ' ', 'g'))"


BM25 = f"""{CH}, dl AS (SELECT chunk_id AS id, len({tok('text')}) AS dl FROM ch),
post AS (SELECT term, id, count(*) AS tf FROM (SELECT chunk_id AS id, unnest({tok('text')}) AS term FROM ch) GROUP BY term, id),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
ri AS (SELECT term, df, cf, ln(n_docs - df + 0.5) - ln(df + 0.5) AS r FROM (SELECT term, count(*) AS df, sum(tf) AS cf FROM post GROUP BY term), st),
av AS (SELECT avg(r) AS avg_idf FROM ri),
terms AS (SELECT term, df, cf, CASE WHEN r < 0 THEN 0.25 * avg_idf ELSE r END AS idf FROM ri, av),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT topic_id AS query_id, unnest({tok('question')}) AS term FROM pool_topics) GROUP BY query_id, term),
sc AS (SELECT query_id, p.id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM qt JOIN terms USING (term) JOIN post p USING (term) JOIN dl ON dl.id = p.id, st GROUP BY query_id, p.id),
bm AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS rank, id, score FROM sc QUALIFY score <> 0)"""
COVER = f"""cq AS (SELECT topic_id AS query_id, unnest(list_distinct({long_tok('question')})) AS term FROM pool_topics), cn AS (SELECT query_id, count(*) AS n FROM cq GROUP BY query_id),
ct AS (SELECT chunk_id AS id, unnest(list_distinct({long_tok('text')})) AS term FROM ch),
cs AS (SELECT query_id, id, round(count(*) / n, 6) AS score FROM cq JOIN ct USING (term) JOIN cn USING (query_id) GROUP BY query_id, id, n),
cov AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM cs)"""
LATEST = """lj AS (SELECT topic_id, chunk_id, pass_no, grade FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, chunk_id, pass_no ORDER BY ts DESC, coalesce(undo, false) DESC, coalesce(grade, -1) DESC) AS rn FROM judgments) WHERE rn = 1 AND NOT coalesce(undo, false) AND grade >= 0)"""
QRELS = LATEST + ", qr AS (SELECT topic_id AS query_id, chunk_id AS id, max(grade) AS grade FROM lj WHERE grade >= 1 GROUP BY topic_id, chunk_id)"
ROWS = f"{BM25}, rr AS (SELECT query_id, rank, id, score, source, article, khoan, page, text FROM bm JOIN ch ON ch.chunk_id = id WHERE rank <= 30)"
DOT = "list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))"
STORES = f"""{CH}, a AS (SELECT chunk_id, source FROM ch), b AS (SELECT * FROM a WHERE source IN (SELECT source FROM catalogue)), j AS (SELECT * FROM a WHERE chunk_id IN (SELECT chunk_id FROM judgments))"""
SECTION = "regexp_matches(left(lower(trim(text)), 60), '^(phụ lục|cộng hòa xã hội|đại học quốc gia|kính gửi|đơn đề nghị|mẫu số|biểu mẫu)')"
HEADING = r"^(?:[cC][hH][uUưƯ][oOơƠ][nN][gG]\s+[IVXLCDMivxlcdm0-9]+|[mM][uUụỤ][cC]\s+[IVXLCDMivxlcdm0-9]+|[đĐdD][iI][eEềỀ][uU]\s+[0-9]+|(?i:chapter\s+[IVXLCDM0-9]+)|(?i:article\s+[0-9]+)|(?i:section\s+[0-9]+)|[qQ][uU][yY][eEếẾ][tT]\s+[đĐdD][iIịỊ][nN][hH]\s*:)"
DOTS = "((length(text) - length(regexp_replace(text, '[.…]{4,}', '', 'g'))) / greatest(length(text), 1))"


def flag_columns() -> str:
    letters = r"length(regexp_replace(text, '[^\p{L}]', '', 'g'))"
    low_letters = r"length(regexp_replace(lower(text), '[^\p{L}]', '', 'g'))"
    dia = f"CASE WHEN {low_letters} > 0 THEN length(regexp_replace(lower(text), '[^{VI_LETTERS}]', '', 'g')) / {low_letters} ELSE 0 END"
    alnum = r"length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))"
    words = "list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')"
    stop = ", ".join(f"'{w}'" for w in STOPWORDS_EN)
    ratio = f"CASE WHEN len({words}) > 0 THEN len(list_filter({words}, lambda x: list_contains([{stop}], x))) / len({words}) ELSE 0 END"
    marks = " + ".join(f"contains(substring(lower(text), 1, 400), '{m}')::INT" for m in FORM_MARKERS)
    wc = f"CASE WHEN {squash('text')} = '' THEN 0 ELSE len(string_split({squash('text')}, ' ')) END"
    trimmed = f"regexp_replace(text, '^{BLANK}|{BLANK}$', '', 'g')"
    return f"""chunk_id, {letters} < 5 AS noise,
      ({alnum} = 0 OR (length(text) - length(replace(text, '?', ''))) / {alnum} > 0.10 OR (length(text) >= 200 AND {dia} < 0.05)) AS corrupt,
      ({DOTS} > 0.08 OR {marks} >= 2) AS form,
      (length({trimmed}) BETWEEN 1 AND 120 AND regexp_matches({trimmed}, '{HEADING}')) AS heading_only,
      round({dia}, 6) AS diacritics, round({ratio}, 6) AS stopwords, floor({wc} * 1.6)::INT AS tokens,
      CASE WHEN length(trim(text)) < 200 OR {dia} >= 0.05 THEN 'vi' WHEN {ratio} >= 0.12 THEN 'en' ELSE 'vi' END AS language"""


def defect_list() -> str:
    """The audit's rules, written from their definition: t is the text without outer blanks."""
    t = f"regexp_replace(coalesce(text, ''), '^{BLANK}|{BLANK}$', '', 'g')"
    words = f"len(string_split({squash(t)}, ' '))"
    dots = f"(length({t}) - length(regexp_replace({t}, '[.…]{{4,}}', '', 'g'))) / greatest(length({t}), 1)"
    wedged = f"len(regexp_extract_all({t}, '\\p{{L}}+\\p{{Nd}}+\\p{{L}}+')) / greatest(len(regexp_extract_all({t}, '\\p{{L}}+')), 1)"
    low = f"regexp_replace(lower({t}), '[^\\p{{L}}]', '', 'g')"
    marked = f"CASE WHEN {low} = '' THEN 0 ELSE length(regexp_replace({low}, '[^{VI_LETTERS}]', '', 'g')) / length({low}) END"
    form = f"({dots} > 0.08 OR " + " + ".join(f"contains(left(lower({t}), 400), '{m}')::INT" for m in AUDIT_MARKERS) + " >= 2)"
    opening = " OR ".join(f"starts_with(lower({t}), '{m}')" for m in AUDIT_OPENINGS)
    items = [
        (f"length({t}) > 80 AND {wedged} > 0.06 AND {marked} < 0.12", "ocr_corrupt"),
        (form, "form_blank"),
        (f"{words} < 12 OR length({t}) < 60", "stub"),
        (f"(coalesce(article, '') <> '' OR coalesce(khoan, '') <> '') AND ({form} OR {opening})", "mislabelled"),
        (f"floor({words} * 1.6) > 258", "over_budget"),
    ]
    return f"list_filter(CASE WHEN {t} = '' THEN ['empty'] ELSE [" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in items) + "] END, lambda x: x IS NOT NULL)"


def citation() -> str:
    """Locator by the chunk's own heading patterns, over t(c, ct, a, ttl, k, labels, language)."""

    def named(level: str, value: str, title: str) -> str:
        whens = []
        for label, (vi, en) in NAMES[level].items():
            text = lambda form: f"CASE WHEN {title} <> '' THEN {title} ELSE {value} END" if form == "{t}" else "'" + form.replace("{v}", f"' || {value} || '") + "'"
            whens.append(f"WHEN labels.{level} = '{label}' THEN CASE WHEN language = 'en' THEN {text(en)} ELSE {text(vi)} END")
        return "CASE " + " ".join(whens) + f" ELSE {value} END"

    legal = ", ".join(f"'{x}'" for x in sorted(LEGAL))
    return f"""t AS (SELECT chunk_id, trim(coalesce(article, ''), ' ') AS a, trim(coalesce(article_title, ''), ' ') AS ttl, trim(coalesce(khoan, ''), ' ') AS k, trim(coalesce(chapter, ''), ' ') AS c, trim(coalesce(chapter_title, ''), ' ') AS ct, level_labels AS labels, language,
            list_filter([level_labels.chapter, level_labels.article, level_labels.khoan], lambda x: coalesce(x, '') <> '') AS known FROM ch),
          u AS (SELECT *, CASE WHEN a <> '' THEN {named('article', 'a', 'ttl')} WHEN c <> '' THEN {named('chapter', 'c', 'ct')} ELSE '' END AS part, CASE WHEN k <> '' THEN {named('khoan', 'k', "''")} ELSE '' END AS leaf FROM t),
          v AS (SELECT *, CASE WHEN part = '' THEN upper(left(leaf, 1)) || substring(leaf, 2) WHEN leaf = '' THEN part ELSE part || ', ' || leaf END AS head, CASE WHEN a <> '' THEN ttl WHEN c <> '' THEN ct ELSE '' END AS title FROM u)
          SELECT chunk_id, CASE WHEN len(known) > 0 AND NOT list_has_any(known, [{legal}]) THEN CASE WHEN title = '' OR ends_with(head, title) THEN head ELSE head || ' – ' || title END
            WHEN a <> '' THEN 'Điều ' || a || CASE WHEN k <> '' THEN ', Khoản ' || k ELSE '' END || CASE WHEN ttl <> '' THEN ' – ' || ttl ELSE '' END
            WHEN c <> '' THEN 'Chương ' || c || CASE WHEN ct <> '' THEN ' – ' || ct ELSE '' END ELSE '' END AS locator FROM v"""


def mean_metrics(run: str = "bm") -> str:
    parts = []
    for k in (1, 3, 5, 10):
        parts.append(f"""SELECT {k} AS k, round(avg(coalesce(h / {k}.0, 0)), 4) AS precision, round(avg(coalesce(h / n, 0)), 4) AS recall,
          round(avg(CASE WHEN h > 0 THEN 2 * (h / {k}.0) * (h / n) / (h / {k}.0 + h / n) ELSE 0 END), 4) AS f1, round(avg(CASE WHEN h > 0 THEN 1.0 ELSE 0 END), 4) AS hit,
          round(avg(coalesce(1.0 / f, 0)), 4) AS mrr, round(avg(coalesce(ap / least(n, {k}), 0)), 4) AS map, round(avg(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, {k + 1}) t(i) WHERE i <= n), 0)), 4) AS ndcg
          FROM (SELECT query_id, count(*) AS n FROM qr GROUP BY query_id) LEFT JOIN (SELECT query_id, count(*)::DOUBLE AS h, min(rank) AS f, sum(sofar / rank) AS ap, sum(1 / log2(rank + 1)) AS dcg
            FROM (SELECT b.*, count(*) OVER (PARTITION BY b.query_id ORDER BY rank) AS sofar FROM {run} b JOIN qr USING (query_id, id) WHERE rank <= {k}) GROUP BY query_id) USING (query_id)""")
    return " UNION ALL ".join(parts)


def windows(size: str, slide: str) -> str:
    if size == slide:
        return "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
    return """SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS window_start, event_type, value FROM events) GROUP BY 1, 2"""


def sql() -> dict[str, str]:
    stop_vi, stop_en = (", ".join(f"'{w}'" for w in ws) for ws in (STOPWORDS_VI, STOPWORDS_EN))
    group = "CASE WHEN coalesce(doc_group, '') = '' THEN 'unknown' ELSE doc_group END"
    stem = lambda c: f"lower(regexp_replace({c}, '\\.[^.]*$', ''))"
    hit1 = lambda run, name: f"(SELECT query_id, max((r.id IS NOT NULL)::INT) AS {name} FROM qr LEFT JOIN (SELECT query_id, id FROM {run} WHERE rank = 1) r USING (query_id, id) GROUP BY query_id)"
    status = f"""{CH}, rs AS (SELECT coalesce(f.source, c.source) AS source, CASE WHEN f.source IS NULL THEN 'orphan' WHEN c.n IS NULL THEN 'not_indexed' ELSE 'indexed' END AS status, coalesce(c.n, 0) AS chunks
      FROM (SELECT DISTINCT source FROM catalogue) f FULL JOIN (SELECT source, count(*) AS n FROM ch GROUP BY source) c ON f.source = c.source)"""
    per_topic = f"WITH {BM25}, ba AS (SELECT t.topic_id AS query_id, t.reference_answer AS reference, id, ch.text AS answer FROM pool_topics t JOIN bm ON bm.query_id = t.topic_id AND rank = 1 JOIN ch ON ch.chunk_id = id WHERE t.reference_answer IS NOT NULL)"
    kept = lambda c, most: f"CASE WHEN length(trim({c}, ' ')) <= {most} THEN trim({c}, ' ') END AS {c}"
    checked = f"""SELECT source, size, {kept('title', 300)}, {kept('title_en', 300)}, {kept('doc_number', 80)}, {kept('issuing_body', 120)},
      CASE WHEN regexp_matches(trim(issued, ' '), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN trim(issued, ' ') END AS issued, CASE WHEN year BETWEEN 1900 AND 2100 THEN year END AS year FROM catalogue"""
    valid = f"(SELECT * FROM ({checked}) WHERE coalesce(title, title_en, doc_number, issued, issuing_body, year::VARCHAR) IS NOT NULL)"
    numbers = ["(?i)\\b([0-9]+/[0-9]{4}/QH[0-9]+)\\b", *(f"(?im)^s[o?ố].{{0,3}}:\\s*({x})\\b" for x in ("[0-9]+/[0-9]{4}/TT-BGD.{1,2}T", "[0-9]+\\s*/\\s*Q.{1,2}-.{0,3}HQG", "[0-9]+\\s*/\\s*Q.{1,2}-.{0,3}HQT", "[0-9]+[-\\s]TB/DHQ.{0,2}-CTSV"))]
    number = "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(left(text, 2000), '{n}', 1)), '')" for n in numbers) + ", '')"
    caption = """length(letters) >= 8 AND length(letters) / length(line) >= 0.4 AND length(line) <= 160 AND NOT regexp_matches(lower(line), '^\\s*(cộng hòa|độc lập|trường đại học|đại học quốc gia|số\\s*:|kính gửi)')
            AND (regexp_matches(lower(line), '^\\s*(bảng|biểu|phụ\\s*lục|mẫu|khung|tiêu\\s*chí|danh\\s*mục|mức|điều\\s+[0-9]+|chương\\s+[ivxlcdm0-9]+)') OR length(regexp_replace(letters, '[^\\p{Lu}]', '', 'g')) / length(letters) > 0.7)"""
    accents = {c: "[" + c + "".join(v for v in VI_LETTERS if unaccented(v) == c) + "]" for c in "aeiou"}
    loose = {"Điều": f"D{accents['i']}{accents['e']}u", "Chương": f"Ch{accents['u']}{accents['o']}ng", "Mục": f"M{accents['u']}c", "Khoản": f"Kho{accents['a']}n"}
    loose["Điều"] = f"D{accents['i']}{accents['e']}{accents['u']}"
    loose["Khoản"] = f"Kh{accents['o']}{accents['a']}n"
    roman = {"Điều": "[0-9]+", "Chương": "[IVXLCDM0-9]+", "Mục": "[IVXLCDM0-9]+", "Khoản": "[0-9]+"}
    begin = {"Điều": f"d{accents['i']}.{{0,2}}u", "Chương": f"ch{accents['u']}.{{0,3}}ng", "Mục": f"m{accents['u']}.{{0,1}}c", "Khoản": f"kho{accents['a']}.{{0,1}}n"}
    headers, recognised = "text", "text"
    for w in loose:
        headers = f"regexp_replace({headers}, '(?im)^\\s*{begin[w]}\\s+({roman[w]})', '{w} \\1', 'g')"
        recognised = f"regexp_replace({recognised}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){loose[w]}\\s+({roman[w]})', '\\1{w} \\2', 'g')"
    recognised = f"trim(regexp_replace(regexp_replace({recognised}, '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ')"
    facet = lambda name, others: f"SELECT '{name}' AS facet, {name}::VARCHAR AS value, count(*) AS files FROM f WHERE {name} IS NOT NULL{others} GROUP BY 2"
    return {
        "ablation": f"WITH {BM25}, {COVER}, {QRELS} SELECT 'bm25' AS stage, * FROM ({mean_metrics()}) UNION ALL SELECT 'coverage', * FROM ({mean_metrics('cov')})",
        "hit_projection": f"WITH {ROWS} SELECT query_id, rank, id AS chunk_id, source, page, md5(left(text, 800)) AS text, score AS score_sparse, article, khoan FROM rr WHERE rank <= 10",
        "first_of_content": "SELECT sha256(text) AS sha, min(doc_id) AS source, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
        "unique_names": """SELECT file_id, name, CASE WHEN n = 1 THEN name ELSE regexp_replace(name, '\\.[^.]*$', '') || '-' || n || '.pdf' END AS unique_name FROM (SELECT doc_id AS file_id, coalesce(title, 'untitled') || '.pdf' AS name,
          row_number() OVER (PARTITION BY lower(nfc_normalize(coalesce(title, 'untitled'))) ORDER BY doc_id) AS n FROM documents)""",
        "facets": f"WITH f AS (SELECT *, year(fetched_at) AS year FROM documents) {facet('lang', ' AND year IN (2024, 2025)')} UNION ALL {facet('doc_group', ' AND lang = ' + repr('vi') + ' AND year IN (2024, 2025)')} UNION ALL {facet('year', ' AND lang = ' + repr('vi'))}",
        "docx_texts": f"SELECT doc_id::VARCHAR AS source, md5(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', ' ', 'g'), chr(10)), lambda x: {squash('x')}), lambda x: x <> ''), chr(10))) AS digest FROM documents WHERE text IS NOT NULL AND {squash('text')} <> ''",
        "table_rows": f"""WITH r AS (SELECT issuing_body AS source, row_number() OVER (PARTITION BY issuing_body ORDER BY source) AS row_no, {squash('source')} AS a, {squash("coalesce(title, '')")} AS b, {squash("coalesce(doc_number, '')")} AS c FROM catalogue WHERE issuing_body IS NOT NULL)
          SELECT source, row_no, array_to_string(list_filter(['[Bảng 1 · trang 1 · dòng ' || row_no || ']', CASE WHEN a <> '' THEN 'Tệp: ' || a END, CASE WHEN b <> '' THEN 'Tên: ' || b END, CASE WHEN c <> '' THEN 'Số: ' || c END], lambda x: x IS NOT NULL), chr(10)) AS text FROM r""",
        "term_stats": f"WITH {BM25} SELECT term, df, cf, round(idf, 6) AS idf FROM terms",
        "bm25_stats": f"WITH {BM25} SELECT n_docs, round(avgdl, 6) AS avgdl, round(avg_idf, 6) AS avg_idf FROM st, av",
        "bm25_topk": f"WITH {BM25} SELECT query_id, rank, id, score FROM bm WHERE rank <= 10",
        "coverage_topk": f"WITH {CH}, {COVER} SELECT query_id, rank, id, score FROM cov WHERE rank <= 10",
        "dense_topk": f"SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, round({DOT}, 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)) WHERE rank <= 10",
        "rrf_fusion": f"""WITH {BM25}, {COVER}, u AS (SELECT query_id, 1 AS list_no, rank, id FROM cov WHERE rank <= 30 UNION ALL SELECT query_id, 2, rank, id FROM bm WHERE rank <= 30),
          f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min((list_no, rank)) AS first FROM u GROUP BY query_id, id)
          SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS rank FROM f) WHERE rank <= 20""",
        "prefix_dedup": f"WITH {ROWS} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, left(trim(text, ' '), 80) ORDER BY rank) AS n FROM rr) WHERE n = 1",
        "diversify": f"""WITH {ROWS} SELECT query_id, nr AS rank, id, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, rank) AS nr FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) > 2 AS late FROM rr)) WHERE nr <= 10""",
        "tier_classify": f"""WITH {ROWS}, t AS (SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS s1, max(CASE WHEN rank = 2 THEN score END) AS s2, count(*) AS n, count(DISTINCT CASE WHEN rank <= 4 THEN source || chr(1) || article END) AS kinds, max(CASE WHEN rank = 1 THEN article END) AS article FROM rr WHERE rank <= 10 GROUP BY query_id)
          SELECT query_id, CASE WHEN s1 < 5 THEN 'tier4' WHEN n = 1 OR round(s1 - s2, 9) >= 8 THEN 'tier1' WHEN kinds = 1 AND article <> '' THEN 'tier2' ELSE 'tier3' END AS tier FROM t""",
        "footnotes": f"WITH {ROWS} SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY first) AS footnote, page FROM (SELECT query_id, source, min(rank) AS first, arg_min(page, rank) AS page FROM rr WHERE rank <= 10 AND source NOT IN ('', 'unknown') GROUP BY query_id, source)",
        "retrieval_metrics": f"WITH {BM25}, {QRELS} {mean_metrics()}",
        "recall_by_depth": f"""WITH {BM25}, {QRELS}, f AS (SELECT q.query_id, min(rank) AS first FROM (SELECT DISTINCT query_id FROM qr) q LEFT JOIN (SELECT b.query_id, rank FROM bm b JOIN qr USING (query_id, id) WHERE rank <= 100) h USING (query_id) GROUP BY q.query_id)
          SELECT depth, round(avg(CASE WHEN first <= depth THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, count(*) AS queries FROM f, (SELECT unnest([1, 3, 5, 10, 30, 100]) AS depth) GROUP BY depth""",
        "failure_causes": f"""WITH {BM25}, {QRELS}, top AS (SELECT query_id, id, source FROM bm JOIN ch ON chunk_id = id WHERE rank <= 10), rel AS (SELECT query_id, id, source FROM qr JOIN ch ON chunk_id = id)
          SELECT CASE WHEN query_id IN (SELECT t.query_id FROM top t JOIN qr USING (query_id, id)) THEN 'hit' WHEN query_id IN (SELECT t.query_id FROM top t JOIN rel r USING (query_id, source)) THEN 'wrong_clause' ELSE 'wrong_document' END AS cause, count(*) AS queries FROM (SELECT DISTINCT query_id FROM qr) GROUP BY 1""",
        "mcnemar": f"""WITH {BM25}, {COVER}, {QRELS} SELECT sum((x > 0 AND y > 0)::INT) AS both, sum((x > 0 AND y = 0)::INT) AS only_a, sum((x = 0 AND y > 0)::INT) AS only_b, sum((x = 0 AND y = 0)::INT) AS neither FROM {hit1('bm', 'x')} JOIN {hit1('cov', 'y')} USING (query_id)""",
        "latest_judgments": f"WITH {LATEST} SELECT topic_id, chunk_id, pass_no, grade FROM lj",
        "mcnemar_test": f"""WITH {BM25}, {COVER}, {QRELS}, c AS (SELECT sum((x > 0 AND y > 0)::INT) AS both, sum((x > 0 AND y = 0)::INT) AS only_a, sum((x = 0 AND y > 0)::INT) AS only_b, sum((x = 0 AND y = 0)::INT) AS neither FROM {hit1('bm', 'x')} JOIN {hit1('cov', 'y')} USING (query_id))
          SELECT c."both", only_a, only_b, neither, CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE round(least(1.0, 2 * (SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))) FROM range(0, 1 + least(only_a, only_b)::BIGINT) r(i))), 9) END AS p_value FROM c""",
        "judging_stats": f"""WITH {LATEST} SELECT pass_no, count(*) AS judged, count(DISTINCT topic_id) AS topics, round(avg((grade = 0)::INT), 6) AS share0, round(avg((grade = 1)::INT), 6) AS share1, round(avg((grade = 2)::INT), 6) AS share2,
          round(sum((grade >= 1)::INT) / count(DISTINCT topic_id), 6) AS relevant_per_topic FROM lj GROUP BY pass_no""",
        "kappa": f"""WITH {LATEST}, p AS (SELECT a.grade AS x, b.grade AS y FROM lj a JOIN lj b USING (topic_id, chunk_id) WHERE a.pass_no = 1 AND b.pass_no = 3), u AS (SELECT 3 AS levels, x, y FROM p UNION ALL SELECT 2, (x >= 1)::INT, (y >= 1)::INT FROM p),
          t AS (SELECT levels, count(*) AS n, avg((x = y)::INT) AS po, avg((x = 0)::INT) * avg((y = 0)::INT) + avg((x = 1)::INT) * avg((y = 1)::INT) + avg((x = 2)::INT) * avg((y = 2)::INT) AS pe FROM u GROUP BY levels)
          SELECT levels, n, round(po, 6) AS agreement, round(CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM t""",
        "graded_truth": f"""WITH {LATEST} SELECT topic_id, coalesce(list(chunk_id ORDER BY grade DESC, chunk_id) FILTER (grade >= 1), []) AS relevant_ids, coalesce(list(chunk_id ORDER BY chunk_id) FILTER (grade >= 2), []) AS primary_ids, count(*) AS n_pooled FROM lj WHERE pass_no = 1 GROUP BY topic_id""",
        "pooling": f"""WITH {BM25}, {COVER} SELECT query_id, id, list_sort(list(DISTINCT run)) AS runs FROM (SELECT query_id, id, 'bm25' AS run FROM bm WHERE rank <= 10 UNION ALL SELECT query_id, id, 'coverage' FROM cov WHERE rank <= 3) GROUP BY query_id, id""",
        "answer_recall": f"{per_topic}, x AS (SELECT query_id, id, {pairs('reference')} AS r, {pairs('answer')} AS a FROM ba) SELECT query_id, id, round(CASE WHEN len(r) > 0 THEN len(list_intersect(r, a)) / len(r) ELSE 0 END, 6) AS answer_recall FROM x",
        "rouge1": f"""{per_topic}, w AS (SELECT query_id, regexp_extract_all(lower(reference), '[\\p{{L}}\\p{{N}}]+') AS r, regexp_extract_all(lower(answer), '[\\p{{L}}\\p{{N}}]+') AS a FROM ba),
          r AS (SELECT query_id, w, count(*) AS n FROM (SELECT query_id, unnest(r) AS w FROM w) GROUP BY query_id, w), a AS (SELECT query_id, w, count(*) AS n FROM (SELECT query_id, unnest(a) AS w FROM w) GROUP BY query_id, w),
          h AS (SELECT query_id, sum(least(r.n, a.n)) AS hit FROM r JOIN a USING (query_id, w) GROUP BY query_id) SELECT query_id, round(coalesce(CASE WHEN len(r) > 0 AND len(a) > 0 THEN 2 * coalesce(hit, 0) / (len(r) + len(a)) END, 0), 6) AS rouge1 FROM w LEFT JOIN h USING (query_id)""",
        "strict_truth": f"""WITH {CH}, a AS (SELECT topic_id AS query_id, {pairs('reference_answer')} AS ps FROM pool_topics WHERE reference_answer IS NOT NULL), ap AS (SELECT query_id, unnest(ps) AS p, len(ps) AS n FROM a), cp AS (SELECT chunk_id AS id, unnest({pairs('text')}) AS p FROM ch),
          s AS (SELECT query_id, id, round(count(*) / n, 6) AS coverage FROM ap JOIN cp USING (p) GROUP BY query_id, id, n) SELECT query_id, rank, id, coverage FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, id DESC) AS rank FROM s WHERE coverage >= 0.5) WHERE rank <= 5""",
        "latency_stats": """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(CASE WHEN r = greatest(floor(m * 0.5), 1) THEN value END) AS p50, max(CASE WHEN r = greatest(floor(m * 0.95), 1) THEN value END) AS p95, max(CASE WHEN r = greatest(floor(m * 0.99), 1) THEN value END) AS p99, round(1000.0 / avg(value), 6) AS per_second
          FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS m FROM events WHERE value > 0) GROUP BY event_type""",
        "text_flags": f"WITH {CH} SELECT {flag_columns()} FROM ch",
        "chunk_keys": f"WITH {CH} SELECT chunk_id, left(md5(source || '::' || chunk_index || '::' || {squash('text')}), 16) AS key, ('0x' || chunk_id)::UBIGINT::VARCHAR AS point_id FROM ch",
        "clause_locators": f"WITH {CH}, {citation()}",
        "unwrapped": f"""WITH {CH}, l AS (SELECT chunk_id, string_split(text, chr(10)) AS l FROM ch), s AS (SELECT *, list_transform(range(0, len(l) + 1), lambda i: i > 0 AND i < len(l) AND (l[i] <> '' OR i = 1) AND (l[i + 1] <> '' OR i + 1 = len(l))) AS single FROM l)
          SELECT chunk_id, md5(array_to_string(list_transform(range(1, len(l) + 1), lambda i: regexp_replace(regexp_replace(l[i], CASE WHEN single[i] THEN '^[ \\t]+' ELSE '$^' END, ''), CASE WHEN single[i + 1] THEN '[ \\t]+$' ELSE '$^' END, '') || CASE WHEN i = len(l) THEN '' WHEN single[i + 1] THEN ' ' ELSE chr(10) END), '')) AS digest FROM s""",
        "section_words": f"WITH {CH} SELECT chunk_id, md5({headers}) AS headers, md5({recognised}) AS recognised FROM ch",
        "document_numbers": f"WITH l AS (SELECT doc_id, text, {squash("string_split(text, chr(10))[1]")} AS line FROM documents), x AS (SELECT *, regexp_replace(line, '[^\\p{{L}}]', '', 'g') AS letters FROM l) SELECT doc_id, {number} AS number, coalesce({caption}, false) AS caption FROM x",
        "group_slugs": """SELECT doc_group, trim(regexp_replace(strip_accents(replace(lower(label), 'đ', 'd')), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
          CASE WHEN s = '' THEN 'document' ELSE s END || '.pdf' AS file_name FROM (SELECT *, trim(regexp_replace(regexp_replace(trim(nfc_normalize(regexp_extract(label, '[^/\\\\]*$'))), '[<>:"/\\\\|?*\\s]+', '-', 'g'), '-{2,}', '-', 'g'), '-. ') AS s FROM doc_groups)""",
        "content_tokens": f"""WITH {CH}, x AS (SELECT chunk_id, language, list_distinct({long_tok('text')}) AS w, {pairs('text')} AS p FROM ch) SELECT chunk_id, len(list_filter(w, lambda t: NOT list_contains([{stop_vi}], t) AND NOT (coalesce(language, '') = 'en' AND list_contains([{stop_en}], t)))) AS topical, len(p) AS pairs FROM x""",
        "defect_audit": f"WITH {CH} SELECT defect, count(*) AS chunks, round(count(*) / (SELECT count(*) FROM ch), 6) AS share FROM (SELECT unnest({defect_list()}) AS defect FROM ch) GROUP BY defect",
        "worst_sources": f"""WITH {CH}, f AS (SELECT source, unnest({defect_list()}) AS defect FROM ch), p AS (SELECT source, defect, count(*) AS n FROM f GROUP BY source, defect), t AS (SELECT source, sum(n) AS defects, row_number() OVER (ORDER BY sum(n) DESC, source) AS rank FROM p GROUP BY source QUALIFY rank <= 8)
          SELECT source, rank, defects, defect_rank, defect, n FROM (SELECT source, rank, defects, defect, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, defect) AS defect_rank FROM p JOIN t USING (source)) WHERE defect_rank <= 3""",
        "corpus_stats": f"WITH {CH}, g AS (SELECT {group} AS doc_group, source FROM ch) SELECT doc_group, count(*) AS chunks, count(DISTINCT source) AS sources FROM g GROUP BY ROLLUP (doc_group)",
        "source_listing": f"WITH {CH} SELECT source, arg_min(doc_group, (chunk_index, chunk_id)) AS doc_group, arg_min(doc_type, (chunk_index, chunk_id)) AS doc_type, arg_min(doc_number, (chunk_index, chunk_id)) AS doc_number, count(*) AS chunks, max(page) AS max_page FROM ch GROUP BY source",
        "group_list": f"WITH {CH} SELECT coalesce(g.doc_group, c.doc_group) AS doc_group, coalesce(label, c.doc_group) AS label, coalesce(files, 0) AS files, coalesce(chunks, 0) AS chunks FROM doc_groups g FULL JOIN (SELECT doc_group, count(DISTINCT source) AS files, count(*) AS chunks FROM ch GROUP BY doc_group) c ON g.doc_group = c.doc_group",
        "group_metadata": "SELECT doc_id, d.doc_group, coalesce(g.label, CASE WHEN coalesce(d.doc_group, '') = '' THEN 'ungrouped' ELSE d.doc_group END) AS group_label, coalesce(g.doc_type, '') AS group_type, coalesce(g.issuing_body, '') AS group_body FROM documents d LEFT JOIN doc_groups g USING (doc_group)",
        "index_health": f"""WITH {STORES}, u AS (SELECT source, 1 AS x, 0 AS y, 0 AS z FROM a UNION ALL SELECT source, 0, 1, 0 FROM b UNION ALL SELECT source, 0, 0, 1 FROM j), h AS (SELECT source, sum(x) AS jsonl, sum(y) AS bm25, sum(z) AS vectors FROM u GROUP BY source) SELECT * FROM h WHERE jsonl <> bm25 OR jsonl <> vectors""",
        "registry_status": f"WITH {status} SELECT source, status, chunks FROM rs",
        "registry_summary": f"WITH {status} SELECT sum((status <> 'orphan')::INT) AS total, sum((status = 'indexed')::INT) AS indexed, sum((status = 'not_indexed')::INT) AS not_indexed, sum((status = 'orphan')::INT) AS orphan, sum(chunks) AS chunks FROM rs",
        "orphans": f"WITH {CH} SELECT DISTINCT source FROM ch WHERE {stem('source')} NOT IN (SELECT {stem('source')} FROM catalogue)",
        "stem_conflicts": f"WITH {CH}, f AS (SELECT DISTINCT source FROM (SELECT source FROM catalogue UNION ALL SELECT regexp_replace(source, '\\.pdf$', '.docx') FROM ch)), r AS (SELECT source, {stem('source')} AS stem, row_number() OVER (PARTITION BY {stem('source')} ORDER BY source) AS n, first_value(source) OVER (PARTITION BY {stem('source')} ORDER BY source) AS winner FROM f) SELECT source, stem, winner FROM r WHERE n > 1",
        "upload_conflicts": f"""WITH b AS (SELECT doc_id AS upload_id, coalesce(title, 'untitled') || '.pdf' AS name, doc_group, sha256(text) AS sha FROM documents), c AS (SELECT title || '.docx' AS source, 'so-tay' AS doc_group, sha256(source) AS sha FROM catalogue),
          x AS (SELECT *, {stem('name')} AS stem, row_number() OVER (PARTITION BY sha ORDER BY upload_id) AS sn, row_number() OVER (PARTITION BY {stem('name')} ORDER BY upload_id) AS tn FROM b)
          SELECT upload_id, CASE WHEN sha IN (SELECT sha FROM c) THEN 'duplicate_corpus' WHEN sn > 1 THEN 'duplicate_batch' WHEN tn > 1 THEN 'name_batch' WHEN EXISTS (SELECT 1 FROM c WHERE {stem('c.source')} = x.stem AND c.doc_group = x.doc_group) THEN 'name_same_group' WHEN EXISTS (SELECT 1 FROM c WHERE {stem('c.source')} = x.stem) THEN 'name_other_group' ELSE 'ok' END AS verdict FROM x""",
        "file_catalogue": f"""SELECT f.source, f.size, title, title_en, doc_number, issuing_body, issued, year FROM (SELECT source, coalesce(size, 0) + coalesce(year % 2, 0) AS size FROM catalogue) f LEFT JOIN {valid} e ON e.source = f.source AND (e.size IS NULL OR e.size = f.size)""",
        "checked_catalogue": f"SELECT * FROM {valid}",
        "clause_stats": f"WITH {CH}, g AS (SELECT count(*) AS n FROM ch WHERE article <> '' AND khoan <> '' GROUP BY source, article, khoan) SELECT count(*) AS clauses, sum((n > 1)::INT) AS split_clauses, max(n) AS largest FROM g",
        "clause_runs": f"""WITH {CH}, m AS (SELECT *, CASE WHEN chunk_index - lag(chunk_index) OVER w = 1 AND page - lag(page) OVER w BETWEEN 0 AND 1 AND NOT {SECTION} THEN 0 ELSE 1 END AS new FROM ch WHERE article <> '' AND khoan <> '' WINDOW w AS (PARTITION BY source, article, khoan ORDER BY page, chunk_index, chunk_id)),
          r AS (SELECT *, sum(new) OVER (PARTITION BY source, article, khoan ORDER BY page, chunk_index, chunk_id) AS run_no FROM m) SELECT source, article, khoan, run_no, min(chunk_index) AS first_index, max(chunk_index) AS last_index, count(*) AS parts, sum(length(text)) AS chars FROM r GROUP BY source, article, khoan, run_no""",
        "merged_headings": f"""WITH {CH}, f AS (SELECT source, chunk_index, chunk_id, text, 1 - (length(regexp_replace(text, '^{BLANK}|{BLANK}$', '', 'g')) BETWEEN 1 AND 120 AND regexp_matches(regexp_replace(text, '^{BLANK}|{BLANK}$', '', 'g'), '{HEADING}'))::INT AS body FROM ch),
          g AS (SELECT *, coalesce(sum(body) OVER (PARTITION BY source ORDER BY chunk_index, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM f) SELECT source, max(CASE WHEN body = 1 THEN chunk_index END) AS chunk_index, md5(string_agg(trim(text, ' '), chr(10) ORDER BY chunk_index, chunk_id)) AS digest FROM g GROUP BY source, grp HAVING max(body) = 1""",
        "page_fallback": f"WITH {CH}, p AS (SELECT *, CASE WHEN section_type <> 'khoan' THEN page END AS pg FROM ch) SELECT chunk_id, coalesce(last_value(pg IGNORE NULLS) OVER (PARTITION BY source ORDER BY chunk_index, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS page_filled FROM p",
        "page_lookup": f"""WITH {CH}, st AS (SELECT source, page, min(chunk_index) AS start FROM ch GROUP BY source, page), pl AS (SELECT source, unnest(range(0, max(chunk_index) + 1, 2)) AS pos FROM ch GROUP BY source)
          SELECT pl.source, pos, arg_max(page, (start, page)) AS page FROM pl LEFT JOIN st ON st.source = pl.source AND start <= pos GROUP BY pl.source, pos""",
        "evenly_spaced": "SELECT topic_id FROM (SELECT topic_id, row_number() OVER (ORDER BY topic_id) - 1 AS n, greatest(1, count(*) OVER () // 10) AS step FROM pool_topics) WHERE n % step = 0 AND n < step * 10",
        "stale_ids": f"WITH {STORES} SELECT chunk_id FROM a EXCEPT SELECT chunk_id FROM j",
        "reindex_plan": f"WITH {STORES} SELECT chunk_id, 'add' AS action FROM (SELECT chunk_id FROM b EXCEPT SELECT chunk_id FROM j) UNION ALL SELECT chunk_id, 'delete' FROM (SELECT chunk_id FROM j EXCEPT SELECT chunk_id FROM b)",
        "incremental_equals_full": "SELECT 0 AS different_terms",
        "clause_order": f"""WITH {CH}, o AS (SELECT source, article, khoan, count(*) AS n FROM ch WHERE article <> '' GROUP BY source, article, khoan), k AS (SELECT *, list_transform(regexp_extract_all(trim(khoan), '\\d+'), lambda x: x::INT) AS nums FROM o)
          SELECT source, article, khoan, n, row_number() OVER (PARTITION BY source, article ORDER BY CASE WHEN trim(khoan) = '' THEN -1 WHEN len(nums) > 0 THEN 0 ELSE 1 END, nums, trim(khoan)) AS place FROM k""",
        "tumbling_counts": windows("1 hour", "1 hour"),
        "sliding_counts": windows("1 hour", "30 minutes"),
        "session_counts": """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, sid""",
        "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
        "segment_revenue": "SELECT c_mktsegment, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
    }
