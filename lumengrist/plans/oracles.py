"""DuckDB SQL for the queries' results, over the same Parquet tables."""

from __future__ import annotations

from .. import constants as C

#: One for each way through the relaxed matching.
SEARCHES = [
    (1, "that with the"),
    (2, "thintion worthless the"),
    (3, "thintion worthless"),
    (4, "pathetic worthless onbleea that with"),
    (5, "zzzunknown thintion"),
    (6, "zzzunknown"),
]
SUGGEST_FOR = [(1, "thintion"), (2, "worthless"), (3, "the"), (4, "onbl"), (5, "zzzunknown")]
LINES = ["  /k abc ", "/s abc", "abc", "/k", "/x", "", "/k  abc", "/help", "/quit", "\t/s a b\t"]
#: No two of these words share a character, so there is one way to cut a text made of them.
CJK_VOCABULARY = ("人工", "智能", "机器", "学习", "深度", "翻译", "应用", "数据", "模型", "语言", "图像", "识别", "和")
CJK_STOP = ("和",)
CJK_SEARCHES = [(1, "人工智能"), (2, "机器学习和模型 GPT"), (3, "翻译"), (4, "图像识别，数据模型语言"), (5, "GPT"), (6, "深度学习应用人工")]
#: What the queries' words are, as cut.
CJK_KEYWORDS = [(1, "人工"), (1, "智能"), (2, "机器"), (2, "学习"), (2, "模型"), (2, "GPT"), (3, "翻译"), (4, "图像"), (4, "识别"), (4, "，"), (4, "数据"), (4, "模型"), (4, "语言"), (5, "GPT"), (6, "深度"), (6, "学习"), (6, "应用"), (6, "人工")]
#: How the texts of the registry are to be cut.
CJK_CUT = [(1, ["人工智能", "和", "机器学习"]), (2, ["深度学习", " ", "GPT", " ", "应用"]), (3, ["机器翻译"])]
CJK_WORDS = [(1, "人工智能"), (2, "GPT"), (3, "深度a"), (4, ""), (5, "学"), (6, "龥鿿"), (7, "人 工")]

_STOP = ", ".join(f"('{w}')" for w in C.STOP_WORDS)
_values = lambda rows: ", ".join(f"({i}::BIGINT, '{t}')" for i, t in rows)
_WORDS = "string_split(lower(regexp_replace(coalesce({0}, ''), '[^A-Za-z]+', ' ', 'g')), ' ')"

TOK = f"tok AS (SELECT doc_id, term FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents) WHERE term <> '')"
TF = TOK + ", tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)"
def _weights(tf: str, documents: str) -> str:
    return f""", dl AS (SELECT doc_id, sum(tf)::BIGINT AS doc_len FROM {tf} GROUP BY doc_id), df AS (SELECT term, count(*) AS df FROM {tf} GROUP BY term),
n AS (SELECT (SELECT count(*) FROM {documents})::BIGINT AS n_docs, (SELECT sum(doc_len) FROM dl)::DOUBLE / (SELECT count(*) FROM {documents}) AS avgdl),
post AS (SELECT term, doc_id, tf, df, log2((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * ({C.K1}::DOUBLE + 1.0::DOUBLE)
                / (tf + {C.K1}::DOUBLE * (1.0::DOUBLE - {C.B}::DOUBLE + {C.B}::DOUBLE * doc_len / avgdl)) AS weight
         FROM {tf} JOIN dl USING (doc_id) JOIN df USING (term), n)"""


BM25 = TF + _weights("tf", "documents")
DICT = TOK + ", dict AS (SELECT row_number() OVER (ORDER BY term) AS line_num, term, count(*) AS freq FROM tok GROUP BY term)"
CHARS = DICT + ", chars AS (SELECT DISTINCT ch, line_num FROM (SELECT line_num, unnest(string_split(term, '')) AS ch FROM dict) WHERE ch <> '')"
TOP = TF + f""", sized AS (SELECT doc_id, greatest({C.LEAST_KEYWORDS}, least({C.MOST_KEYWORDS}, strlen(coalesce(text, '')) // {C.BYTES_PER_KEYWORD})) AS top_n FROM documents),
top AS (SELECT doc_id, rank, term, tf FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rank FROM tf JOIN sized USING (doc_id)) WHERE rank <= top_n)"""
_half = lambda at: f"('0x' || substr(md5(term), {at}, 8))::BIGINT"
FP = TOP + f""", h AS (SELECT doc_id, tf, {_half(1)} AS hi, {_half(9)} AS lo FROM top),
bits AS (SELECT doc_id, bit, sum(CASE WHEN (hi >> bit) & 1 = 1 THEN tf ELSE -tf END) AS hi, sum(CASE WHEN (lo >> bit) & 1 = 1 THEN tf ELSE -tf END) AS lo
         FROM h, (SELECT unnest(range(32))::INTEGER AS bit) GROUP BY ALL),
fps AS (SELECT d.doc_id, coalesce(sum(CASE WHEN hi > 0 THEN (1::BIGINT << bit) ELSE 0 END), 0)::BIGINT AS fp_hi, coalesce(sum(CASE WHEN lo > 0 THEN (1::BIGINT << bit) ELSE 0 END), 0)::BIGINT AS fp_lo
        FROM documents d LEFT JOIN bits USING (doc_id) GROUP BY d.doc_id)"""
BLOCKS = FP + ", blocks AS (SELECT doc_id, i::BIGINT AS block_no, [fp_hi >> 16, fp_hi & 65535, fp_lo >> 16, fp_lo & 65535][i + 1] AS block_val FROM fps, range(4) r(i))"
REPS = FP + """, rep AS (SELECT fp_hi, fp_lo, min(doc_id) AS id FROM fps GROUP BY ALL)"""
PAIRS = FP + f""", pairs AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, (bit_count(xor(a.fp_hi, b.fp_hi)) + bit_count(xor(a.fp_lo, b.fp_lo)))::BIGINT AS distance
FROM fps a JOIN fps b ON a.doc_id < b.doc_id WHERE bit_count(xor(a.fp_hi, b.fp_hi)) + bit_count(xor(a.fp_lo, b.fp_lo)) <= {C.FINGERPRINT_DISTANCE})"""


_KEPT = f"""RECURSIVE {PAIRS}, near AS MATERIALIZED (SELECT row_number() OVER (ORDER BY d.doc_id) AS rn, d.doc_id, coalesce(l.before, []::BIGINT[]) AS before
      FROM documents d LEFT JOIN (SELECT doc_b, list(doc_a) AS before FROM pairs GROUP BY doc_b) l ON l.doc_b = d.doc_id),
      g(rn, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT near.rn, CASE WHEN list_has_any(g.kept, near.before) THEN g.kept ELSE list_append(g.kept, near.doc_id) END FROM g JOIN near ON near.rn = g.rn + 1),
      kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS new_id, doc_id FROM (SELECT unnest(kept) AS doc_id FROM (SELECT kept FROM g ORDER BY rn DESC LIMIT 1)))"""
_KEPT_BM25 = _KEPT + ", ktf AS (SELECT new_id AS doc_id, term, tf FROM tf JOIN kept USING (doc_id))" + _weights("ktf", "kept")
_CJK = f"""w AS (SELECT [{', '.join(f"'{w}'" for w in CJK_VOCABULARY)}] AS v),
tok AS (SELECT doc_id, v[(doc_id * 7 + j * (1 + doc_id % 5) + j // 4) % {len(CJK_VOCABULARY)} + 1] AS term FROM (SELECT doc_id, unnest(range(5 + doc_id % 11)) AS j FROM documents), w)"""
_CJK_DICT = _CJK + f", dict AS (SELECT row_number() OVER (ORDER BY encode(term)) AS line_num, term, count(*) AS freq FROM tok WHERE term NOT IN ({', '.join(f"'{w}'" for w in CJK_STOP)}) GROUP BY term)"


def _kw(searches: list[tuple[int, str]], stop: bool = False) -> str:
    out = f"q(query_id, text) AS (VALUES {_values(searches)}), kw AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({_WORDS.format('text')}) AS term FROM q) WHERE term <> ''"
    return out + (f" AND term NOT IN (SELECT w FROM (VALUES {_STOP}) s(w)))" if stop else ")")


def _search(searches: list[tuple[int, str]], stop: bool = False, base: str = BM25, kw: str = "") -> str:
    return f"""{base}, {kw or _kw(searches, stop)},
known AS (SELECT query_id, count(*) AS n_known FROM kw WHERE term IN (SELECT term FROM post) GROUP BY query_id),
scored AS (SELECT query_id, doc_id, count(*) AS matches, round(sum(weight), {C.DIGITS}) AS score FROM kw JOIN post USING (term) GROUP BY ALL),
lim AS (SELECT query_id, n_known, greatest(1, (n_known * {C.RELAXED_PERCENT} + 99) // 100) AS n60 FROM known),
need AS (SELECT query_id, CASE WHEN count(*) FILTER (matches >= n_known) >= {C.TOP_K} THEN n_known
                               WHEN n60 < n_known AND count(*) FILTER (matches >= n60) >= {C.TOP_K} THEN n60 ELSE 1 END AS min_matches
         FROM scored JOIN lim USING (query_id) GROUP BY query_id, n_known, n60),
found AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored s JOIN need USING (query_id) WHERE matches >= min_matches) WHERE rank <= {C.TOP_K})"""


def _kwic(source: str) -> str:
    """source: rows src(query_id, doc_id, content) and kw(query_id, term)."""
    return f"""{source},
cut AS (SELECT query_id, doc_id, term, length(content) AS size, string_split(content, term) AS parts FROM src JOIN kw USING (query_id)),
hit AS (SELECT query_id, doc_id, term, size, list_sum(list_transform(parts[1:i], lambda p: length(p)))::BIGINT + (i - 1) * length(term) AS pos
        FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM cut WHERE len(parts) > 1)),
win AS (SELECT query_id, doc_id, greatest(0, pos - {C.HALF_WINDOW})::BIGINT AS "begin", least(size, pos + length(term) + {C.HALF_WINDOW})::BIGINT AS "end" FROM hit),
isl AS (SELECT *, CASE WHEN max("end") OVER (PARTITION BY query_id, doc_id ORDER BY "begin", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < "begin" THEN 1 ELSE 0 END AS fresh FROM win),
num AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id, doc_id ORDER BY "begin", "end" ROWS UNBOUNDED PRECEDING) AS island FROM isl),
mer AS (SELECT query_id, doc_id, min("begin") AS "begin", max("end") AS "end", count(*) AS hits FROM num GROUP BY query_id, doc_id, island),
best AS (SELECT query_id, doc_id, "begin", "end", hits FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY hits DESC, "end" - "begin" DESC, "begin") AS r FROM mer) WHERE r = 1),
abs AS (SELECT s.query_id, s.doc_id, CASE WHEN s.content = '' THEN ''
               WHEN b."begin" IS NULL THEN left(s.content, {C.PLAIN_SNIPPET}) || CASE WHEN length(s.content) > {C.PLAIN_SNIPPET} THEN '...' ELSE '' END
               ELSE CASE WHEN b."begin" > 0 THEN '...' ELSE '' END || substr(s.content, b."begin" + 1, b."end" - b."begin") || CASE WHEN b."end" < length(s.content) THEN '...' ELSE '' END END AS abstract
        FROM src s LEFT JOIN best b USING (query_id, doc_id))"""


_RANKED = "SELECT query_id, rank, doc_id, matches, score FROM found"
_FOUND = _kwic(_search(SEARCHES) + ", src AS (SELECT query_id, doc_id, coalesce(text, '') AS content FROM found JOIN documents USING (doc_id))")
_NEAR = f"""{CHARS}, q(query_id, query) AS (VALUES {_values(SUGGEST_FOR)}),
rchar AS (SELECT DISTINCT query_id, line_num FROM (SELECT query_id, unnest(string_split(query, '')) AS ch FROM q) JOIN chars USING (ch)),
rpre AS (SELECT query_id, line_num FROM q JOIN dict ON starts_with(term, query)),
rec AS (SELECT * FROM rchar UNION SELECT * FROM rpre),
near AS (SELECT query_id, query, term, freq, levenshtein(query, term) AS distance FROM rec JOIN dict USING (line_num) JOIN q USING (query_id)
         WHERE term <> query AND abs(length(term) - length(query)) <= {C.MAX_DISTANCE} AND levenshtein(query, term) <= {C.MAX_DISTANCE})"""
_JACCARD = f"""{_NEAR}, dt AS (SELECT DISTINCT doc_id, term FROM tok), sz AS (SELECT term, count(*) AS n FROM dt GROUP BY term),
com AS (SELECT query_id, near.term, count(*) AS common FROM near JOIN dt a ON a.term = near.term JOIN dt b ON b.term = near.query AND a.doc_id = b.doc_id GROUP BY ALL),
jac AS (SELECT near.query_id, near.term, CASE WHEN s.n IS NULL OR r.n IS NULL THEN 0.0::DOUBLE ELSE coalesce(common, 0)::DOUBLE / (s.n + r.n - coalesce(common, 0)) END AS jaccard
        FROM near LEFT JOIN sz s ON s.term = near.term LEFT JOIN sz r ON r.term = near.query LEFT JOIN com ON com.query_id = near.query_id AND com.term = near.term)"""
_SCORED = f"""{_JACCARD}, raw AS (SELECT near.query_id, near.term, jaccard, 1.0::DOUBLE - distance::DOUBLE / greatest(length(query), length(near.term)) AS edit_sim,
       log2(1.0::DOUBLE + freq) / log2(1.0::DOUBLE + (SELECT greatest(1, max(freq)) FROM dict)) AS freq_score FROM near JOIN jac ON jac.query_id = near.query_id AND jac.term = near.term),
sco AS (SELECT query_id, term, round(jaccard, {C.DIGITS}) AS jaccard, round(edit_sim, {C.DIGITS}) AS edit_sim, round(freq_score, {C.DIGITS}) AS freq_score,
       round({C.JACCARD_WEIGHT}::DOUBLE * jaccard + {C.EDIT_WEIGHT}::DOUBLE * edit_sim + {C.FREQUENCY_WEIGHT}::DOUBLE * freq_score, {C.DIGITS}) AS score FROM raw),
rk AS (SELECT query_id, rank, term, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term) AS rank FROM sco) WHERE rank <= {C.SUGGESTIONS})"""
_PAGE_BM25 = BM25.replace(_WORDS.format("text"), "string_split(lower(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'), '[^\\p{L}]+', ' ', 'g')), ' ')").replace("SELECT doc_id, unnest", "SELECT page_id AS doc_id, unnest").replace("FROM documents", "FROM pages")
_STORE = """s AS (SELECT doc_id, strlen('<doc>' || chr(10) || chr(9) || '<docid>' || doc_id || '</docid>' || chr(10) || chr(9) || '<link></link>' || chr(10) || chr(9) || '<title></title>' || chr(10) || chr(9)
                  || '<content>' || coalesce(text, '') || '</content>' || chr(10) || '</doc>' || chr(10)) AS length FROM documents),
o AS (SELECT doc_id, coalesce(sum(length) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", length FROM s)"""
_TURNS = "m AS (SELECT conv_id AS conn_id, CASE WHEN role = 'user' THEN 0 ELSE 1 END::BIGINT AS type, coalesce(text, '') AS text FROM conversations)"
_ANSWERS = "SELECT query_id, rank, found.doc_id, score, abstract FROM found JOIN abs USING (query_id, doc_id)"

ORACLES = {
    "text_strip_tags": "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS content FROM pages",
    "page_extract": "SELECT page_id AS doc_id, coalesce(url, '') AS link, regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1) AS title, regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g') AS content FROM pages",
    "tokenize_ascii": f"WITH {TOK} SELECT doc_id, term, count(*) AS n FROM tok GROUP BY ALL",
    "token_stopword_anti": f"WITH {TOK} SELECT doc_id, term, count(*) AS n FROM tok WHERE term NOT IN (SELECT w FROM (VALUES {_STOP}) s(w)) GROUP BY ALL",
    "cjk_filter": f"WITH w(id, word) AS (VALUES {_values(CJK_WORDS)}) SELECT id, word FROM w WHERE regexp_full_match(word, '[\\x{{4E00}}-\\x{{9FFF}}]+')",
    "char_explode": f"WITH w(id, word) AS (VALUES {_values(CJK_WORDS)}) SELECT id, i AS pos, word[i + 1] AS ch FROM (SELECT *, unnest(range(length(word))) AS i FROM w)",
    "tokenize_cjk": f"SELECT id::BIGINT AS id, pos::INTEGER AS pos, word FROM (VALUES {', '.join(f"({i}, {n}, '{w}')" for i, words in CJK_CUT for n, w in enumerate(words))}) t(id, pos, word)",
    "rss_items": """SELECT lpad(page_id::VARCHAR, 12, '0') AS path, url AS link, 'T' || page_id AS title, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS content_md5 FROM pages WHERE page_id % 7 <> 0""",
    "dict_freq": f"WITH {DICT} SELECT term, freq FROM dict",
    "dict_line_num": f"WITH {DICT} SELECT line_num, term FROM dict",
    "char_index": f"WITH {CHARS} SELECT ch, line_num FROM chars",
    "page_offsets": f'WITH {_STORE} SELECT doc_id, "offset", length FROM o',
    "offsets_import": f'WITH {_STORE} SELECT doc_id, "offset", length FROM o',
    "index_export": f"WITH {BM25} SELECT term, term || ' ' || string_agg(doc_id || ' ' || printf('%g', weight), ' ' ORDER BY doc_id) AS line FROM post GROUP BY term",
    "index_deduplicated": f"WITH {_KEPT_BM25} SELECT term, doc_id, tf, round(weight, {C.DIGITS}) AS weight FROM post",
    "page_fetch": f"WITH {_search(SEARCHES, base=_KEPT_BM25)} SELECT query_id, rank, found.doc_id, '' AS link, '' AS title, md5(coalesce(text, '')) AS content_md5 FROM found JOIN kept ON kept.new_id = found.doc_id JOIN documents d ON d.doc_id = kept.doc_id WHERE NOT contains(coalesce(text, ''), '<')",
    "dict_cjk": f"WITH {_CJK_DICT} SELECT line_num, term, freq FROM dict",
    "char_index_cjk": f"WITH {_CJK_DICT}, chars AS (SELECT DISTINCT ch, line_num FROM (SELECT line_num, unnest(string_split(term, '')) AS ch FROM dict) WHERE ch <> '') SELECT ch, ch || ' ' || string_agg(line_num::VARCHAR, ' ' ORDER BY line_num) AS line FROM chars GROUP BY ch",
    "search_cjk": "WITH " + _search([], base=_CJK + ", tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)" + _weights("tf", "documents"), kw=f"kw(query_id, term) AS (VALUES {_values(CJK_KEYWORDS)})") + " " + _RANKED,
    "client_command": f"""WITH l(line) AS (VALUES {', '.join(f"('{x}')" for x in LINES)}), t AS (SELECT line, trim(line, ' ' || chr(9)) AS t FROM l),
      a AS (SELECT *, CASE WHEN t = '' THEN 'ignore' WHEN t = '/quit' THEN 'quit' WHEN t = '/help' THEN 'help' WHEN regexp_matches(t, '^/[ks] .') THEN 'send' WHEN t[1] = '/' THEN 'unknown' ELSE 'send' END AS action FROM t)
      SELECT line, action, CASE WHEN action <> 'send' THEN -1 WHEN t LIKE '/k %' THEN 0 ELSE 1 END::BIGINT AS type, CASE WHEN action <> 'send' THEN '' WHEN t[1] = '/' THEN t[4:] ELSE t END AS text FROM a""",
    "dict_export": f"WITH {DICT} SELECT line_num, term || ' ' || freq AS line FROM dict",
    "char_index_export": f"WITH {CHARS} SELECT ch, ch || ' ' || string_agg(line_num::VARCHAR, ' ' ORDER BY line_num) AS line FROM chars GROUP BY ch",
    "index_import": f"WITH {BM25} SELECT term, doc_id, printf('%.5e', weight)::DOUBLE AS weight FROM post",
    "dict_import": f"WITH {DICT} SELECT line_num, term, freq FROM dict",
    "dict_max_freq": f"WITH {DICT} SELECT greatest(1, max(freq)) AS max_freq FROM dict",
    "char_index_import": f"WITH {CHARS} SELECT ch, line_num FROM chars",
    "doc_len": f"WITH {TF} SELECT doc_id, sum(tf)::BIGINT AS doc_len FROM tf GROUP BY doc_id",
    "corpus_stats": f"WITH {BM25} SELECT n_docs, round(avgdl, {C.DIGITS}) AS avgdl FROM n",
    "term_idf": f"WITH {BM25} SELECT term, df, round(log2((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), {C.DIGITS}) AS idf FROM df, n",
    "bm25_postings": f"WITH {BM25} SELECT term, doc_id, tf, round(weight, {C.DIGITS}) AS weight FROM post",
    "simhash_topn": f"WITH {TOP} SELECT doc_id, rank, term, tf FROM top",
    "simhash_fp": f"WITH {FP} SELECT doc_id, fp_hi, fp_lo FROM fps",
    "simhash_blocks": f"WITH {BLOCKS} SELECT doc_id, block_no, block_val FROM blocks",
    "dup_candidates": f"WITH {BLOCKS} SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM blocks a JOIN blocks b ON a.block_no = b.block_no AND a.block_val = b.block_val AND a.doc_id < b.doc_id",
    "dup_pairs": f"""WITH {REPS} SELECT a.id AS doc_a, b.id AS doc_b, (bit_count(xor(a.fp_hi, b.fp_hi)) + bit_count(xor(a.fp_lo, b.fp_lo)))::BIGINT AS distance
      FROM rep a JOIN rep b ON a.id < b.id WHERE bit_count(xor(a.fp_hi, b.fp_hi)) + bit_count(xor(a.fp_lo, b.fp_lo)) <= {C.FINGERPRINT_DISTANCE}
      UNION ALL SELECT id, doc_id, 0 FROM fps JOIN rep USING (fp_hi, fp_lo) WHERE doc_id <> id""",
    "dedup_greedy": f"WITH {_KEPT} SELECT new_id, doc_id FROM kept",
    "query_keywords": f"WITH {_kw(SEARCHES)} SELECT query_id, term FROM kw",
    "search_scores": f"WITH {_search(SEARCHES)} SELECT query_id, doc_id, matches, score FROM scored",
    "search_progressive": f"WITH {_search(SEARCHES)} {_RANKED}",
    "search_stopwords": f"WITH {_search(SEARCHES, True)} {_RANKED}",
    "search_and": f"WITH {_search([SEARCHES[0]])} {_RANKED}",
    "search_60": f"WITH {_search([SEARCHES[1], SEARCHES[3]])} {_RANKED}",
    "search_or": f"WITH {_search([SEARCHES[2]])} {_RANKED}",
    "search_empty": f"WITH {_search([SEARCHES[5]])} {_RANKED}",
    "kwic_hits": f'WITH {_FOUND} SELECT query_id, doc_id, "begin", "end" FROM win',
    "kwic_merged": f'WITH {_FOUND} SELECT query_id, doc_id, "begin", "end", hits FROM mer',
    "kwic_best": f'WITH {_FOUND} SELECT query_id, doc_id, "begin", "end", hits FROM best',
    "kwic_abstract": f"WITH {_FOUND} SELECT query_id, doc_id, abstract FROM abs",
    "kwic_fallback": "WITH " + _kwic("kw(query_id, term) AS (VALUES (1::BIGINT, 'zzzunknown')), src AS (SELECT 1::BIGINT AS query_id, doc_id, coalesce(text, '') AS content FROM documents)") + " SELECT doc_id, abstract FROM abs",
    "search_pages": f"WITH {_FOUND} SELECT query_id, rank, found.doc_id, '' AS title, '' AS link, abstract FROM found JOIN abs USING (query_id, doc_id)",
    "stream_search": f"WITH {_FOUND} {_ANSWERS}",
    "recall_char": f"WITH {_NEAR} SELECT query_id, line_num FROM rchar",
    "recall_prefix": f"WITH {_NEAR} SELECT query_id, line_num FROM rpre",
    "recall_union": f"WITH {_NEAR} SELECT query_id, line_num FROM rec",
    "edit_prune": f"WITH {_NEAR} SELECT query_id, term, distance FROM near",
    "jaccard_docs": f"WITH {_JACCARD} SELECT query_id, term, round(jaccard, {C.DIGITS}) AS jaccard FROM jac",
    "freq_score": f"WITH {DICT} SELECT term, round(log2(1.0::DOUBLE + freq) / log2(1.0::DOUBLE + (SELECT greatest(1, max(freq)) FROM dict)), {C.DIGITS}) AS freq_score FROM dict",
    "hybrid_score": f"WITH {_SCORED} SELECT query_id, term, jaccard, edit_sim, freq_score, score FROM sco",
    "recommend_topk": f"WITH {_SCORED} SELECT query_id, rank, term, score FROM rk",
    "recommend_json": f"""WITH {_SCORED} SELECT query_id, '["' || string_agg(term, '","' ORDER BY rank) || '"]' AS json FROM rk GROUP BY query_id""",
    "tlv_encode": "SELECT conv_id, turn, '00000001' || printf('%08X', strlen(coalesce(text, ''))) || hex(encode(coalesce(text, ''))) AS frame FROM conversations",
    "tlv_decode": f"WITH {_TURNS} SELECT conn_id, type, strlen(text)::BIGINT AS length, md5(text) AS value_md5 FROM m",
    "stream_messages": f"WITH {_TURNS} SELECT conn_id, type, md5(text) AS value_md5 FROM m",
    "request_dispatch": f"WITH {_TURNS} SELECT conn_id, type, CASE WHEN type = 0 THEN 2 ELSE 3 END::BIGINT AS response_type, md5(text) AS text_md5 FROM m",
    "ext_cooccur_recall": f"""WITH {TF}, q(query_id, text) AS (VALUES {_values(SUGGEST_FOR)}), c AS (SELECT query_id, b.term, count(*) AS common FROM q JOIN tf a ON a.term = q.text JOIN tf b USING (doc_id) WHERE b.term <> q.text GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY common DESC, term) AS rank FROM c) SELECT query_id, rank, term, common FROM r WHERE rank <= {C.SUGGESTIONS}""",
    "ext_search_pages_multilang": f"WITH {_search(SEARCHES, base=_PAGE_BM25)} {_RANKED}",
}
ORACLES["response_parse"] = ORACLES["search_pages"]
_PAGES_JSON = "to_json(list({'abstract': abstract, 'id': found.doc_id, 'link': '', 'title': ''} ORDER BY rank))::VARCHAR"
ORACLES["search_pages_json"] = f"WITH {_FOUND} SELECT query_id, {_PAGES_JSON} AS json FROM found JOIN abs USING (query_id, doc_id) GROUP BY query_id"
_REQUESTS = [(1 + i % 2, i, kind, q) for i, (kind, (q, _)) in enumerate([(0, q) for q in SUGGEST_FOR] + [(4, (0, ""))] + [(1, q) for q in SEARCHES])]
ORACLES["stream_dispatch"] = f"""WITH r(conn_id, pos, type, query_id) AS (VALUES {", ".join(f"({c}::BIGINT, {a}, {k}, {q})" for c, a, k, q in _REQUESTS)}),
n AS (SELECT *, row_number() OVER (PARTITION BY conn_id ORDER BY pos) - 1 AS no FROM r),
words AS ({ORACLES["recommend_json"]}), pages AS ({ORACLES["search_pages_json"]}),
a AS (SELECT conn_id, no, type + 2 AS kind, coalesce(CASE WHEN type = 0 THEN words.json ELSE pages.json END, '[]') AS json FROM n LEFT JOIN words ON words.query_id = n.query_id LEFT JOIN pages ON pages.query_id = n.query_id WHERE type < 2)
SELECT conn_id, no, printf('%08X', kind) || printf('%08X', strlen(json)) || hex(encode(json)) AS frame FROM a"""
