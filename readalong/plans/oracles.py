"""DuckDB SQL of the registered queries.

Nothing here is taken from the Spark operators; only the inline inputs are shared, and the fixed words and
patterns are written out again.
"""

from __future__ import annotations

from readalong.plans import fixtures

#: Headings from which on a document is left out.  Fixed values.
SECTIONS = ("references?", "bibliography", r"works\s+cited", r"further\s+reading", "acknowledgements?", "appendix", "footnotes?")


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x0b\x1c-\x1f\x85]+|[\s\x0b\x1c-\x1f\x85]+$', '', 'g')"


def _chain(source: str, keep: str, *steps: str) -> str:
    """``source`` (keep, t) through steps that are expressions of t."""
    for step in steps:
        source = f"SELECT {keep}, {step} AS t FROM ({source})"
    return source


_CUT = rf"regexp_replace(t, '(?im)^(?:#{{1,6}}\s*)?(?:{'|'.join(SECTIONS)})\s*$[\s\S]*', '')"
_MARKUP = (
    ("heading", r"regexp_replace(t, '(?m)^#{1,6}\s+', '', 'g')"),
    ("rule", r"regexp_replace(t, '(?m)^[-*_]{3,}\s*$', '', 'g')"),
    ("fence", r"regexp_replace(t, '```[\s\S]*?```', '', 'g')"),
    ("code", r"regexp_replace(t, '`([^`\n]+)`', '\1', 'g')"),
    ("image", r"regexp_replace(t, '!\[.*?\]\(.*?\)', '', 'g')"),
    ("link", r"regexp_replace(t, '\[([^\]]+)\]\([^\)]+\)', '\1', 'g')"),
    ("star", r"regexp_replace(t, '\*{1,3}([^*\n]+)\*{1,3}', '\1', 'g')"),
    ("underscore", r"regexp_replace(t, '_{1,3}([^_\n]+)_{1,3}', '\1', 'g')"),
    ("br", r"regexp_replace(t, '(?i)<\s*br\s*/?\s*>', chr(10), 'g')"),
    ("tag", r"regexp_replace(t, '</?[^>]+>', '', 'g')"),
)
_LINES = r"string_split(regexp_replace(t, '\n$', ''), chr(10))"
_ITEM = r"regexp_extract(regexp_replace(l, '\s+$', ''), '^\s*(?:[-+*]|\d+[.)])\s+(.+?)\s*$', 1)"
_LISTS = rf"array_to_string(list_transform({_LINES}, lambda l: CASE WHEN {_ITEM} = '' THEN l WHEN regexp_matches({_ITEM}, '[.!?:;]$') THEN {_ITEM} ELSE {_ITEM} || '.' END), chr(10))"
_SPACES = (r"regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g')", r"regexp_replace(t, '[ \t]{2,}', ' ', 'g')", r"regexp_replace(t, '(?m)^\s+$', '', 'g')", _strip("t"))
_CLEAN = (_CUT, *(s for _, s in _MARKUP), _LISTS, *_SPACES)
_WRAPPED = (
    "SELECT doc_id, '# Part ' || doc_id || '⏎⏎---⏎⏎**Note** on `code` and ![pic](a.png) a [link](http://example.org).<br>⏎- first item⏎- second item!⏎⏎| Kind | Share |⏎|---|---|⏎| prose | most |⏎⏎' || coalesce(text, '') || '⏎⏎```⏎x = 1⏎```⏎<i>end</i>  of   it⏎⏎⏎⏎## References⏎[1] left out' AS t FROM documents".replace("⏎", "' || chr(10) || '")
)


def _clean_steps() -> str:
    source = f"SELECT doc_id, text AS raw, text AS t FROM ({fixtures.MARKUP})"
    keep = "doc_id, raw"
    for name, step in _MARKUP:
        source = f"SELECT {keep}, {step} AS t, {step} AS after_{name} FROM ({source})"
        keep += f", after_{name}"
    cleaned = _chain(f"SELECT doc_id, text AS t FROM ({fixtures.MARKUP})", "doc_id", *_CLEAN)
    return f"SELECT s.* EXCLUDE (raw, t), {_CUT.replace('(t,', '(raw,')} AS cut, c.t AS cleaned FROM ({source}) s JOIN ({cleaned}) c USING (doc_id)"


def _split_after(x: str, marks: str) -> str:
    return rf"string_split(regexp_replace({x}, '([{marks}])\s+', '\1' || chr(1), 'g'), chr(1))"


def _chunks(source: str, most: int = 600, headings: str = "ORDER BY 1") -> str:
    """CTEs that end in ``chunks`` (doc_id, chunk_index, text) of ``source`` (doc_id, text)."""
    return rf"""WITH RECURSIVE d AS ({source}),
b0 AS (SELECT doc_id, unnest(l) AS b, generate_subscripts(l, 1) AS blk FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n+'), lambda x: {_strip('x')}), lambda x: x <> '') AS l FROM d)),
b1 AS (SELECT doc_id, blk, array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda x: {_strip('x')}), lambda x: x <> ''), ' ') AS f FROM b0),
b2 AS (SELECT doc_id, blk, CASE WHEN length(f) <= 120 AND len(string_split_regex(f, '\s+')) <= 14 AND NOT regexp_matches(f, '[.!?:]$') THEN f || '.' ELSE f END AS f FROM b1 WHERE f <> ''),
s0 AS (SELECT doc_id, blk, unnest(l) AS s, generate_subscripts(l, 1) AS sn FROM (SELECT doc_id, blk, list_filter(list_transform({_split_after('f', '.!?')}, lambda x: {_strip('x')}), lambda x: x <> '') AS l FROM b2)),
p0 AS (SELECT doc_id, blk, sn, length(s) > {most} AS long, unnest(l) AS s, generate_subscripts(l, 1) AS cn FROM (SELECT *, CASE WHEN length(s) > {most} THEN {_split_after('s', ';,')} ELSE [s] END AS l FROM s0)),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, blk ORDER BY sn, cn) AS seq FROM p0),
r AS (SELECT doc_id, blk, seq, sn, long, s, 1 AS unit, length(s) + 1 AS size FROM p WHERE seq = 1
  UNION ALL SELECT p.doc_id, p.blk, p.seq, p.sn, p.long, p.s,
    CASE WHEN p.long <> r.long OR (p.long AND p.sn <> r.sn) OR r.size + length(p.s) + 1 > {most} THEN r.unit + 1 ELSE r.unit END,
    CASE WHEN p.long <> r.long OR (p.long AND p.sn <> r.sn) OR r.size + length(p.s) + 1 > {most} THEN length(p.s) + 1 ELSE r.size + length(p.s) + 1 END
  FROM r JOIN p ON p.doc_id = r.doc_id AND p.blk = r.blk AND p.seq = r.seq + 1),
u AS (SELECT doc_id, blk, unit, {_strip("string_agg(s, ' ' ORDER BY seq)")} AS text FROM r GROUP BY doc_id, blk, unit),
chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY blk, unit) - 1 AS INTEGER) AS chunk_index, text FROM u WHERE text <> '')"""


_DOC_CHUNKS = _chunks("SELECT doc_id, text FROM documents")


def _timing(chunks: str) -> str:
    """CTEs that end in ``timing`` of a relation with doc_id, chunk_index, text."""
    return f"""ms AS (SELECT *, 120 + 55 * length(text) AS ms FROM {chunks}),
timing AS (SELECT doc_id, chunk_index, text, round((sum(ms) OVER w - ms) / 1000, 3) AS "start", round(sum(ms) OVER w / 1000, 3) AS "end" FROM ms WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING))"""


_DOC_TIMING = f"{_DOC_CHUNKS}, {_timing('chunks')}"
_TURNS = "turns AS (SELECT conv_id AS doc_id, turn AS chunk_index, coalesce(text, '') AS text FROM conversations)"
_TOKENS = r"list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z0-9'']+'), lambda w: regexp_replace(replace(lower(w), '’', ''''), '[^a-z0-9'']+', '', 'g')), lambda w: w <> '')"


def _tokens(x: str) -> str:
    return _TOKENS.replace("{x}", x)


_FP = rf"""{_strip(r"regexp_replace(regexp_replace(lower(txt), '\d+', ' ', 'g'), '\s+', ' ', 'g')")}"""
_CENTER = "((y0 + y1) / 2 / coalesce(nullif(height, 0), 800))"
_OVERLAP = "CASE WHEN least({a}.x1, {b}.x1) <= greatest({a}.x0, {b}.x0) OR least({a}.y1, {b}.y1) <= greatest({a}.y0, {b}.y0) THEN 0.0 ELSE (least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * (least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)) / greatest({least}, ({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0)) END"


def _repeated(blocks: str) -> str:
    return f"SELECT doc_id, fp, count(*) AS n FROM (SELECT doc_id, {_FP} AS fp, {_CENTER} AS c FROM ({blocks})) WHERE (c < 0.08 OR c > 0.88) AND fp <> '' GROUP BY ALL HAVING count(*) >= 2"


_DOC_LINES = "SELECT doc_id, unnest(l) AS txt, CAST(generate_subscripts(l, 1) - 1 AS DOUBLE) AS y0, CAST(generate_subscripts(l, 1) AS DOUBLE) AS y1, CAST(len(l) AS DOUBLE) AS height FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
_FILTERED = f"""SELECT b.doc_id, page_index, pos, txt, CASE
  WHEN r.n IS NOT NULL THEN 'repeated-margin'
  WHEN page_index > 0 AND c < 0.08 AND words <= 20 THEN 'top-margin'
  WHEN c > 0.88 AND words <= 35 THEN 'bottom-margin' END AS drop_reason
FROM (SELECT *, {_FP} AS fp, {_CENTER} AS c, len(list_filter(string_split_regex(txt, '\\s+'), lambda w: w <> '')) AS words FROM ({fixtures.LINES})) b
LEFT JOIN ({_repeated(fixtures.LINES)}) r ON r.doc_id = b.doc_id AND r.fp = b.fp"""


def _columns(blocks: str) -> str:
    """CTE ``cols``: where the columns of each page are split, or null."""
    return f"""cols AS (SELECT doc_id, page_index, CASE WHEN max(gap) > 0.15 * 600 THEN arg_max(x + gap / 2, (gap, x)) END AS split FROM (
  SELECT doc_id, page_index, x, lead(x) OVER (PARTITION BY doc_id, page_index ORDER BY x) - x AS gap FROM (SELECT DISTINCT doc_id, page_index, round_even(x0, 0) AS x FROM ({blocks}))) GROUP BY ALL)"""


def _ordered(blocks: str) -> str:
    """Reading order of blocks."""
    return f"WITH {_columns(blocks)} SELECT b.doc_id, b.page_index, b.ordinal, CASE WHEN split IS NULL THEN 1 ELSE 2 END AS n_columns, split, CAST(row_number() OVER (PARTITION BY b.doc_id, b.page_index ORDER BY CASE WHEN split IS NULL OR x0 < split THEN 0 ELSE 1 END, y0, CASE WHEN split IS NULL THEN x0 ELSE 0 END, ordinal) - 1 AS INTEGER) AS reading_pos FROM ({blocks}) b JOIN cols USING (doc_id, page_index)"


_ACTIVE = """SELECT p.{by}, p.probe_id, p.t, coalesce(max_by(m.idx, (m.t, m.idx)), -1) AS active FROM probes p LEFT JOIN marks m ON m.{by} = p.{by} AND m.t <= p.t GROUP BY ALL"""
_PRINTED = f"""{_TURNS}, said AS (SELECT doc_id, unnest(l) AS norm, chunk_index, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, chunk_index, {_tokens('text')} AS l FROM turns)),
printed AS (SELECT doc_id, norm, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, pos) - 1 AS INTEGER) AS word_idx FROM said)"""


def _boxes(chunks: str) -> str:
    """CTEs that end in ``boxes`` and ``cover`` of token lists ``chunks`` (doc_id, chunk_index, ch) on pages of the turns' words.

    The chunks are made of the same words: all tokens match, and the first place where they stand in a row is the best.
    """
    return f"""{_PRINTED},
ws AS (SELECT doc_id, list(norm ORDER BY word_idx) AS ws FROM printed GROUP BY 1),
ch AS ({chunks}),
st AS (SELECT doc_id, chunk_index, ch, unnest(list_filter(range(len(ws) - len(ch) + 1), lambda s: ws[s + 1] = ch[1] AND list_slice(ws, s + 1, s + len(ch)) = ch)) AS s FROM ch JOIN ws USING (doc_id) WHERE len(ch) > 0),
fs AS (SELECT doc_id, chunk_index, len(any_value(ch)) AS m, min(s) AS s FROM st GROUP BY ALL),
wi AS (SELECT doc_id, chunk_index, m, unnest(range(s, s + m)) AS k FROM fs),
boxes AS (SELECT doc_id, chunk_index, CAST(min(k // 40) AS INTEGER) AS page_index, round(min(k % 10 / 10.0), 6) AS nx0, round(min(k % 40 // 10 / 4.0), 6) AS ny0, round(max((k % 10 + 1) / 10.0), 6) AS nx1, round(max((k % 40 // 10 + 1) / 4.0), 6) AS ny1, CAST(1 AS DOUBLE) AS match_score, CAST(any_value(m) AS INTEGER) AS matched_tokens, CAST(any_value(m) AS INTEGER) AS query_tokens FROM wi GROUP BY ALL HAVING count(DISTINCT k // 40) = 1),
cover AS (SELECT doc_id, count(*) AS n_chunks, count(b.page_index) AS n_mapped, round(count(b.page_index) * 100.0 / count(*), 2) AS coverage FROM ch LEFT JOIN boxes b USING (doc_id, chunk_index) GROUP BY 1)"""


_BOXES = "WITH " + _boxes(f"SELECT doc_id, chunk_index, {_tokens('text')} AS ch FROM turns")
_HIGHLIGHT = "{'chunk_index': chunk_index, 'page_index': page_index, 'nx0': nx0, 'ny0': ny0, 'nx1': nx1, 'ny1': ny1, 'match_score': match_score, 'matched_tokens': matched_tokens, 'query_tokens': query_tokens}"


_ALIGN = f"""WITH RECURSIVE {_PRINTED},
a AS (SELECT doc_id, list(norm ORDER BY word_idx) AS one FROM printed GROUP BY 1),
ab AS (SELECT doc_id, one, list_filter(one, lambda x, k: (k - 1) % 7 <> 3) AS two FROM a),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, CAST(-1 AS BIGINT) AS hit_i, CAST(-1 AS BIGINT) AS hit_j FROM ab
  UNION ALL SELECT doc_id,
    CASE WHEN same THEN i + 1 WHEN p > 0 THEN i WHEN q > 0 THEN i + q ELSE i + 1 END, CASE WHEN same THEN j + 1 WHEN p > 0 THEN j + p WHEN q > 0 THEN j ELSE j + 1 END,
    CASE WHEN same THEN i ELSE -1 END, CASE WHEN same THEN j ELSE -1 END
  FROM (SELECT r.doc_id, i, j, one[i + 1] = two[j + 1] AS same, coalesce(list_position(list_slice(two, j + 2, j + 9), one[i + 1]), 0) AS p, coalesce(list_position(list_slice(one, i + 2, i + 9), two[j + 1]), 0) AS q
    FROM r JOIN ab ON ab.doc_id = r.doc_id WHERE i < len(one) AND j < len(two))),
n AS (SELECT doc_id, count(*) AS n_aligned, CAST(sum(hit_i) AS BIGINT) AS spoken_sum, CAST(sum(hit_j) AS BIGINT) AS printed_sum FROM r WHERE hit_i >= 0 GROUP BY 1)
SELECT doc_id, len(one) AS n_words, n_aligned, spoken_sum, printed_sum, round(n_aligned * 100.0 / len(one), 2) AS coverage FROM ab JOIN n USING (doc_id)"""
_MATCH = f"""WITH RECURSIVE w AS (SELECT string_split('{fixtures.SEQUENCES['words']}', ' ') AS ws),
c AS (SELECT unnest(l) AS text, generate_subscripts(l, 1) - 1 AS chunk_index FROM (SELECT {list(fixtures.SEQUENCES['chunks'])} AS l)),
st AS (SELECT chunk_index, string_split(text, ' ') AS ch, ws, s AS start, least(len(ws), s + greatest(3 * len(string_split(text, ' ')), 24)) AS lim FROM c, w, range(26) AS g(s)),
r AS (SELECT chunk_index, start, ch, ws, lim, 1 AS t, start AS j, CAST([] AS BIGINT[]) AS m FROM st
  UNION ALL SELECT chunk_index, start, ch, ws, lim, t + 1, CASE WHEN hit > 0 THEN j + hit ELSE j END, CASE WHEN hit > 0 THEN list_append(m, j + hit - 1) ELSE m END
  FROM (SELECT *, coalesce(list_position(list_slice(ws, j + 1, least(j + 7, lim)), ch[t]), 0) AS hit FROM r WHERE t <= len(ch))),
b AS (SELECT *, row_number() OVER (PARTITION BY chunk_index ORDER BY len(m) DESC, m[-1] - m[1], start) AS rn FROM r WHERE t = len(ch) + 1 AND len(m) > 0)
SELECT CAST(1 AS BIGINT) AS doc_id, chunk_index, round(len(m) / len(ch), 6) AS score, CAST(m[-1] - m[1] + 1 AS INTEGER) AS span, array_to_string(m, ',') AS matched FROM b WHERE rn = 1 AND len(m) >= least(4, len(ch)) AND len(m) / len(ch) >= 0.33"""


def _tables(source: str) -> str:
    """(doc_id, text) of ``source`` (doc_id, text) with its tables as sentences."""
    return rf"""WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, {_LINES} AS x FROM (SELECT doc_id, text AS t FROM ({source})))),
m AS (SELECT *, regexp_matches(line, '^\s*\|.*\|\s*$') AS tab FROM l),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, tab ORDER BY pos) AS island, {_strip(rf"regexp_replace({_strip('line')}, '^\|+|\|+$', '', 'g')")} AS body FROM m),
c AS (SELECT *, list_transform(string_split(body, '|'), lambda x: {_strip('x')}) AS cells FROM i WHERE tab AND body <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY pos) - 1 AS k, len(list_filter(cells, lambda x: NOT regexp_matches(x, '^:?-{{3,}}:?$'))) = 0 AS mark FROM c),
t AS (SELECT doc_id, island, count(*) AS n, count(*) FILTER (NOT mark) AS n_data, min(k) FILTER (mark) AS first_mark, arg_min(cells, k) FILTER (NOT mark) AS top, min(k) FILTER (NOT mark) AS top_k FROM r GROUP BY ALL),
g AS (SELECT *, coalesce(first_mark = 1 AND len(top) >= 2, false) AS headed FROM t WHERE n >= 2 AND n_data >= 2),
d AS (SELECT r.doc_id, r.pos, list_filter(r.cells, lambda x: x <> '') AS own, CASE WHEN headed THEN top ELSE [] END AS top FROM r JOIN g USING (doc_id, island) WHERE NOT r.mark AND NOT (headed AND r.k = top_k)),
p AS (SELECT *, list_filter(list_transform(range(1, least(len(top), len(own)) + 1), lambda j: CASE WHEN top[j] <> '' THEN top[j] || ': ' || own[j] END), lambda x: x IS NOT NULL) AS pairs FROM d WHERE len(own) > 0),
s AS (SELECT doc_id, pos, CASE WHEN len(pairs) > 0 THEN array_to_string(pairs, '; ') ELSE array_to_string(own, ', ') END AS said FROM p),
o AS (SELECT i.doc_id, i.pos, 1 AS sub, line FROM i LEFT JOIN g ON i.tab AND g.doc_id = i.doc_id AND g.island = i.island WHERE g.doc_id IS NULL
  UNION ALL SELECT doc_id, pos, 1, CASE WHEN regexp_matches(said, '[.!?:;]$') THEN said ELSE said || '.' END FROM s
  UNION ALL SELECT i.doc_id, min(i.pos), 0, 'Table:' FROM i JOIN g USING (doc_id, island) WHERE i.tab GROUP BY i.doc_id, island
  UNION ALL SELECT i.doc_id, max(i.pos), 2, '' FROM i JOIN g USING (doc_id, island) WHERE i.tab GROUP BY i.doc_id, island)
SELECT doc_id, string_agg(line, chr(10) ORDER BY pos, sub) AS text FROM o GROUP BY doc_id"""


#: The whole cleaner over documents inside markup, tables included.
_PLAIN = _chain(_WRAPPED, "doc_id", _CUT, *(s for _, s in _MARKUP))
_SAID = _tables(f"SELECT doc_id, t AS text FROM ({_PLAIN})")
_WITH_TABLES = _chain(f"SELECT doc_id, text AS t FROM ({_SAID})", "doc_id", _LISTS, *_SPACES)


def oracle_sql() -> dict[str, str]:
    """By query name."""
    from readalong.plans import service_oracles

    return _own() | service_oracles.oracle_sql()


def _own() -> dict[str, str]:
    return {
        "clean_text": f"SELECT doc_id, t AS clean_text, t = '' AS is_empty FROM ({_WITH_TABLES})",
        "clean_steps": _clean_steps(),
        "truncate_references": f"SELECT doc_id, {_CUT} AS text FROM (SELECT doc_id, text || chr(10) || '### Works  cited' || chr(10) || 'more' || chr(10) || 'Appendix' || chr(10) || 'rest' AS t FROM documents)",
        "strip_html_pages": f"SELECT page_id, t AS text FROM ({_chain('''SELECT page_id, coalesce(html, '') AS t FROM pages''', 'page_id', _MARKUP[8][1], _MARKUP[9][1], *_SPACES)})",
        "markdown_tables": _tables(fixtures.TABLES),
        "list_items": f"SELECT doc_id, {_LISTS} AS text FROM (SELECT doc_id, text AS t FROM ({fixtures.LISTS}))",
        "chunk_text": f"{_DOC_CHUNKS} SELECT * FROM chunks",
        "heading_units": f"{_chunks(fixtures.HEADINGS)} SELECT * FROM chunks",
        "split_long": rf"""WITH RECURSIVE p AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS seq FROM (SELECT doc_id, {_split_after('text', ';,')} AS l FROM ({fixtures.CLAUSES}))),
r AS (SELECT doc_id, seq, s, 0 AS unit, length(s) + 1 AS size FROM p WHERE seq = 1 UNION ALL SELECT p.doc_id, p.seq, p.s, CASE WHEN r.size + length(p.s) + 1 > 8 THEN r.unit + 1 ELSE r.unit END, CASE WHEN r.size + length(p.s) + 1 > 8 THEN length(p.s) + 1 ELSE r.size + length(p.s) + 1 END FROM r JOIN p ON p.doc_id = r.doc_id AND p.seq = r.seq + 1)
SELECT doc_id, CAST(unit AS INTEGER) AS part_index, string_agg(s, ' ' ORDER BY seq) AS part FROM r GROUP BY doc_id, unit""",
        "split_long_documents": rf"""WITH RECURSIVE p AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS seq FROM (SELECT doc_id, {_split_after("coalesce(text, '')", ';,')} AS l FROM documents)),
r AS (SELECT doc_id, seq, s, 0 AS unit, length(s) + 1 AS size FROM p WHERE seq = 1 UNION ALL SELECT p.doc_id, p.seq, p.s, CASE WHEN r.size + length(p.s) + 1 > 600 THEN r.unit + 1 ELSE r.unit END, CASE WHEN r.size + length(p.s) + 1 > 600 THEN length(p.s) + 1 ELSE r.size + length(p.s) + 1 END FROM r JOIN p ON p.doc_id = r.doc_id AND p.seq = r.seq + 1)
SELECT doc_id, CAST(unit AS INTEGER) AS part_index, string_agg(s, ' ' ORDER BY seq) AS part FROM r GROUP BY doc_id, unit""",
        "fingerprint": f"SELECT {_FP} AS fp, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS txt FROM documents) GROUP BY 1",
        "repeated_margins": f"SELECT *, 'documents' AS origin FROM ({_repeated(_DOC_LINES)}) UNION ALL SELECT *, 'inline' AS origin FROM ({_repeated(fixtures.LINES)})",
        "block_filter": f"SELECT doc_id, page_index, pos, drop_reason, drop_reason IS NULL AS kept FROM ({_FILTERED})",
        "assemble_blocks": f"SELECT doc_id, string_agg(txt, chr(10) || chr(10) ORDER BY page_index, pos) AS text FROM ({_FILTERED}) WHERE drop_reason IS NULL AND trim(txt) <> '' GROUP BY 1",
        "reading_order": _ordered(fixtures.BLOCKS),
        "bbox_overlap": f"SELECT b.doc_id, b.page_index, b.ordinal AS block, r.ordinal AS region, round({_OVERLAP.format(a='b', b='r', least='1e-6')}, 6) AS ratio FROM ({fixtures.BLOCKS}) b JOIN ({fixtures.REGIONS}) r USING (doc_id, page_index)",
        "layout_keep": f"""SELECT doc_id, page_index, ordinal, count(*) FILTER (ratio >= 0.35) AS n_matches, round(max(ratio) FILTER (ratio >= 0.35), 6) AS best_ratio, coalesce(bool_or(keep) FILTER (ratio >= 0.35), false) AS keep
FROM (SELECT b.doc_id, b.page_index, b.ordinal, r.keep, {_OVERLAP.format(a='b', b='r', least='1e-6')} AS ratio FROM ({fixtures.BLOCKS}) b JOIN ({fixtures.REGIONS}) r USING (doc_id, page_index)) GROUP BY ALL""",
        "layout_regions": f"SELECT doc_id, page_index, ordinal, label, round(x0 / 1.5, 6) AS x0, round(y0 / 1.5, 6) AS y0, round(x1 / 1.5, 6) AS x1, round(y1 / 1.5, 6) AS y1, label IN ('plain text', 'title') AS keep FROM ({fixtures.REGIONS}) WHERE confidence >= 0.2",
        "chunk_timing": f'{_DOC_TIMING} SELECT doc_id, chunk_index, "start", "end" FROM timing',
        "total_length": f'{_DOC_TIMING} SELECT doc_id, max_by("end", chunk_index) AS total FROM timing GROUP BY 1',
        "word_timing": f"""WITH {_TURNS}, {_timing('turns')},
w AS (SELECT doc_id, chunk_index, "start", "end", unnest(l) AS norm, generate_subscripts(l, 1) - 1 AS word_pos FROM (SELECT *, {_tokens('text')} AS l FROM timing)),
x AS (SELECT *, length(norm) AS k, sum(length(norm)) OVER (PARTITION BY doc_id, chunk_index) AS total, sum(length(norm)) OVER (PARTITION BY doc_id, chunk_index ORDER BY word_pos ROWS UNBOUNDED PRECEDING) AS upto FROM w)
SELECT doc_id, chunk_index, CAST(word_pos AS INTEGER) AS word_pos, norm, round("start" + ("end" - "start") / total * (upto - k) + 1e-9, 3) AS word_start, round(least("end", "start" + ("end" - "start") / total * upto) + 1e-9, 3) AS word_end FROM x""",
        "tokenize": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_tokens('''coalesce(text, '')''')} AS t FROM documents)",
        "word_order": f"""WITH w AS (SELECT *, min(x0) OVER b AS bx0, min(y0) OVER b AS by0, max(x1) OVER b AS bx1, min(ordinal) OVER b AS seen, regexp_replace(replace(lower(word), '’', ''''), '[^a-z0-9'']+', '', 'g') AS norm FROM ({fixtures.WORDS}) WINDOW b AS (PARTITION BY doc_id, page_index, block_no)),
s AS (SELECT *, CASE WHEN (bx0 + bx1) / 2 < width / 2 - greatest(20, width * 0.04) THEN 0 WHEN (bx0 + bx1) / 2 > width / 2 + greatest(20, width * 0.04) THEN 2 ELSE 1 END AS side FROM w),
t AS (SELECT *, CASE WHEN bool_or(side = 0) OVER p AND bool_or(side = 2) OVER p THEN side ELSE 0 END AS band FROM s WINDOW p AS (PARTITION BY doc_id, page_index))
SELECT doc_id, page_index, ordinal, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_index, band, by0, bx0, seen, line_no, word_no, ordinal) - 1 AS INTEGER) AS word_idx, norm, {', '.join(f'round(coalesce({c} / nullif({s}, 0), 0), 6) AS n{c}' for c, s in (('x0', 'width'), ('y0', 'height'), ('x1', 'width'), ('y1', 'height')))} FROM t WHERE norm <> ''""",
        "match_chunk": _MATCH,
        "chunk_highlights": f"{_BOXES} SELECT * FROM boxes",
        "coverage": f"{_BOXES} SELECT * FROM cover",
        "highlight_payload": f"""{_BOXES}, h AS (SELECT doc_id, list({_HIGHLIGHT} ORDER BY chunk_index) AS l FROM boxes GROUP BY 1)
SELECT doc_id, CAST(to_json({{'n_chunks': n_chunks, 'n_mapped': n_mapped, 'coverage': coverage, 'highlights': coalesce(l, [])}}) AS VARCHAR) AS json FROM cover LEFT JOIN h USING (doc_id)""",
        "polygon_percent": f"{_BOXES} SELECT doc_id, chunk_index, {', '.join(f'round({c} * 100, 4) AS p{k}_{n}' for k, cs in enumerate((('nx0', 'ny0'), ('nx1', 'ny0'), ('nx1', 'ny1'), ('nx0', 'ny1'))) for c, n in zip(cs, 'xy', strict=True))} FROM boxes",
        "wav_duration": "SELECT * FROM (VALUES ('a.wav', CAST(1 AS DOUBLE)), ('b.wav', 0.5), ('c.wav', 0), ('d.wav', 0), ('e.wav', 0)) AS t(path, seconds)",
        "word_alignment": _ALIGN,
        "words_in_blocks": f"""WITH m AS (SELECT w.*, b.ordinal AS block_pos, row_number() OVER (PARTITION BY w.doc_id, w.page_index, w.ordinal ORDER BY b.ordinal) AS rn FROM ({fixtures.WORDS}) w JOIN ({fixtures.REGIONS}) b ON w.doc_id = b.doc_id AND w.page_index = b.page_index AND {_OVERLAP.format(a='w', b='b', least='1.0')} >= 0.5)
SELECT doc_id, page_index, ordinal, block_pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_index, block_pos, block_no, line_no, word_no, y0, x0, ordinal) - 1 AS INTEGER) AS word_idx FROM m WHERE rn = 1""",
        "transcript_words": f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seg, pos) - 1 AS INTEGER) AS word_idx, text, norm, round(coalesce(CAST(t0 AS DOUBLE), 0), 3) AS "start", round(coalesce(CAST(t1 AS DOUBLE), 0), 3) AS "end" FROM (SELECT *, trim(word) AS text, regexp_replace(lower(trim(word)), '[^a-z0-9'']+', '', 'g') AS norm FROM ({fixtures.TRANSCRIPT})) WHERE norm <> ''""",
        "active_chunk": f"""{_DOC_TIMING}, marks AS (SELECT doc_id, "start" AS t, CAST(chunk_index AS BIGINT) AS idx FROM timing),
probes AS (SELECT doc_id, k AS probe_id, round(total * (k - 1) / 17, 3) AS t FROM (SELECT doc_id, max("end") AS total FROM timing GROUP BY 1), range(20) AS g(k)) {_ACTIVE.format(by='doc_id')}""",
        "event_asof": """WITH e AS (SELECT *, epoch_us(ts) AS t, min(event_type) OVER () AS lo, max(event_type) OVER () AS hi FROM events)
SELECT p.user_id, p.event_id, coalesce(max_by(m.event_id, (m.t, m.event_id)), -1) AS latest FROM e p LEFT JOIN e m ON m.user_id = p.user_id AND m.event_type = m.lo AND m.t <= p.t WHERE p.event_type = p.hi GROUP BY ALL""",
        "chunk_nav": f"""{_DOC_CHUNKS}, c AS (SELECT doc_id, chunk_index // 5 AS page_index, chunk_index, lag(chunk_index) OVER w AS p, lead(chunk_index) OVER w AS n FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index))
SELECT doc_id, CAST(page_index AS INTEGER) AS page_index, chunk_index, CAST(p // 5 AS INTEGER) AS prev_page, p AS prev_chunk, CAST(n // 5 AS INTEGER) AS next_page, n AS next_chunk FROM c""",
        "clamp_seek": "SELECT k AS id, greatest(0, least(k - 10, k % 7 - 1)) AS idx, greatest(0.0, least(k * 3.5 - 20, k * 1.25))::DOUBLE AS seek, greatest(0.6, least(2.5, k / 8))::DOUBLE AS zoom FROM range(40) AS r(k)",
        "format_time": f"""{_DOC_TIMING} SELECT doc_id, chunk_index, CAST(floor("end")::BIGINT // 60 AS VARCHAR) || ':' || lpad(CAST(floor("end")::BIGINT % 60 AS VARCHAR), 2, '0') AS label FROM timing""",
        "page_offset": f"SELECT doc_id, page_index, ordinal, doc_id || '_page_' || (page_index + 1) || '.pdf' AS page_name FROM ({fixtures.BLOCKS})",
        "progress_stage": f"""SELECT page_index, page_count, phase, coalesce(list_position(['splitting', 'uploading', 'processing', 'metadata', 'done'], phase) - 1, 0)::INTEGER AS stage, CASE WHEN phase = 'done' THEN page_count ELSE page_index END AS completed,
CASE WHEN page_count > 0 THEN round(least(100, 100.0 * CASE WHEN phase = 'done' THEN page_count ELSE page_index END / page_count), 2) ELSE 0 END::DOUBLE AS percent,
CASE WHEN page_count = 0 THEN 'Preparing pages...' WHEN phase = 'done' THEN 'Completed ' || page_count || '/' || page_count || ' pages' ELSE 'Page ' || (page_index + 1) || '/' || page_count END AS label FROM ({fixtures.PROGRESS})""",
        "chunk_state": f"{_DOC_CHUNKS} SELECT doc_id, CASE WHEN chunk_index = 2 THEN 'active' WHEN chunk_index < 2 THEN 'past' ELSE 'future' END AS state, count(*) AS n FROM chunks GROUP BY ALL",
        "safe_filename": f"""SELECT name, safe, regexp_replace(safe, '[.][^./]+$', '_meta.json') AS meta, coalesce(mime = 'application/pdf', false) OR coalesce(lower(name) LIKE '%.pdf', false) AS is_pdf
FROM (SELECT name, mime, coalesce(nullif(regexp_replace(regexp_replace(coalesce(name, ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'upload') AS safe FROM (SELECT url AS name, NULL AS mime FROM pages UNION ALL SELECT * FROM ({fixtures.FILES})))""",
        "scroll": f"SELECT doc_id, page_index, ordinal, CASE WHEN y0 >= 90 AND y1 <= 270 THEN 0.0 ELSE (y0 + y1) / 2 - 180 END AS by FROM ({fixtures.BLOCKS})",
        "merge_manifest": f"""{_DOC_CHUNKS} SELECT doc_id, string_agg('file ''audio/' || doc_id || '_chunk_' || CASE WHEN chunk_index < 10000 THEN lpad(CAST(chunk_index AS VARCHAR), 4, '0') ELSE CAST(chunk_index AS VARCHAR) END || '.wav''', chr(10) ORDER BY chunk_index) AS manifest FROM chunks GROUP BY 1""",
        "job_status": f"""SELECT job_id, status, CASE WHEN status = 'error' THEN error END AS error, CASE WHEN status = 'done' THEN coalesce(final_mp3, final_wav) END AS audio, CASE WHEN status = 'done' THEN final_mp3 IS NOT NULL END AS has_mp3, CASE WHEN status = 'done' THEN parse_filename(pdf_path) END AS pdf_name, CASE WHEN status = 'processing' THEN 400 ELSE 200 END AS result_code
FROM ({fixtures.JOBS}) WHERE run_id = (SELECT max(run_id) FROM ({fixtures.JOBS}))""",
        "extract_summary": f"SELECT doc_id, length(t) AS char_count, t = '' AS is_empty FROM ({_chain('SELECT doc_id, text AS t FROM documents', 'doc_id', *_CLEAN)})",
        "stream_pages": f"{_DOC_CHUNKS} SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY 1",
    }
