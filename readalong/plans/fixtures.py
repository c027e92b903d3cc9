"""Inline inputs that hold the grammar which the driver's tables lack, as SQL that Spark and DuckDB both read.

``⏎`` stands for a line end.
"""

from __future__ import annotations


def _values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) AS t({columns})"


def _texts(*texts: str) -> str:
    rows = _values("doc_id, raw", *(f"{k}, '{x.replace(chr(39), chr(39) * 2)}'" for k, x in enumerate(texts)))
    return f"SELECT CAST(doc_id AS BIGINT) AS doc_id, replace(raw, '⏎', chr(10)) AS text FROM ({rows}) AS f"


MARKUP = _texts(
    "# Title⏎⏎Some *bold* and __strong__ text with `code` in it.⏎⏎---⏎⏎More.",
    "Body.⏎⏎## References⏎⏎[1] x",
    "A⏎⏎**References**⏎⏎B",
    "2*3*4 and a_b_c",
    "![x](y) z and [label](http://example.org/a)",
    "a < b and c > d",
    "one<br>two<BR />three <b>bold</b>",
    "```⏎code⏎```⏎after",
    "Steps:⏎- Mix⏎- Stir!⏎1. First⏎2) Second;⏎plain",
    "Intro⏎⏎⏎⏎Next   paragraph.⏎   ⏎End",
    "REFERENCES⏎gone",
    "Works  Cited⏎gone",
    "See the appendix⏎stays",
    "",
)

TABLES = _texts(
    "| Model | Cost |⏎|---|:---:|⏎| IT | high |",
    "Before⏎| A | B | C |⏎|---|---|---|⏎| x |  | z |⏎After",
    "| a | b |⏎| c | d |",
    "| only one |",
    "| H | I |⏎|---|---|",
    "| A | B |⏎|---|---|⏎| 1 | 2 |⏎text⏎| p |⏎| q |",
    "no table⏎at all",
    "|  |  |⏎| A |  |⏎|--|---|⏎| 1 | 2 |",
    "| Q | R |⏎|---|---|⏎| yes? | no! |⏎|  |  |⏎| last: | x; |",
)

LISTS = _texts("- bring bread⏎- bring salt", "+ one⏎* two.⏎1. three⏎2) four:⏎ - five", "-nolist⏎1.no⏎text", "- tail?⏎")

HEADINGS = _texts("Intro", "Intro:", "Intro;", "A heading⏎⏎Body text that ends here. And more!", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen")

CLAUSES = _texts("aaa, bb; cccc, d", "123; 4567", "12345678", "abcdefghijkl, mno", "a, b, c, d, e, f")

LINES = _values("doc_id, page_index, pos, y0, y1, height, txt", *(f"{d}, {p}, {k}, CAST({y0} AS DOUBLE), CAST({y1} AS DOUBLE), CAST({h} AS DOUBLE), '{t}'" for d, p, k, y0, y1, h, t in (
    (1, 0, 0, 10, 20, 800, "Journal 1"), (1, 0, 1, 100, 300, 800, "Body text of the first page"), (1, 0, 2, 780, 790, 800, "page 1"),
    (1, 1, 0, 10, 20, 800, "JOURNAL  2"), (1, 1, 1, 400, 420, 800, "Journal 7"), (1, 1, 2, 100, 300, 800, "Body of the second"), (1, 1, 3, 20, 40, 800, "short header line"), (1, 1, 4, 760, 790, 800, "a footer"),
    (2, 0, 0, 10, 20, 0, "Alone 5"), (2, 0, 1, 300, 310, 0, "Text"), (2, 1, 0, 10, 30, 0, ""),
)))

BLOCKS = _values("doc_id, page_index, ordinal, x0, y0, x1, y1, width", *(f"{d}, {p}, {o}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE), CAST({e} AS DOUBLE), CAST(600 AS DOUBLE)" for d, p, o, a, b, c, e in (
    (1, 0, 0, 320, 50, 550, 80), (1, 0, 1, 50, 200, 280, 240), (1, 0, 2, 52, 50, 280, 80), (1, 0, 3, 320, 200, 550, 240),
    (1, 1, 0, 50, 300, 550, 320), (1, 1, 1, 60, 100, 550, 120), (1, 1, 2, 50, 100, 550, 120), (2, 0, 0, 50.5, 10, 100, 20), (2, 0, 1, 140.6, 10, 200, 20),
)))

REGIONS = _values("doc_id, page_index, ordinal, label, confidence, x0, y0, x1, y1, keep", *(f"{d}, {p}, {o}, '{n}', CAST({q} AS DOUBLE), CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE), CAST({e} AS DOUBLE), {k}" for d, p, o, n, q, a, b, c, e, k in (
    (1, 0, 0, "plain text", 0.9, 40, 40, 300, 260, "true"), (1, 0, 1, "figure", 0.8, 310, 40, 560, 90, "false"), (1, 0, 2, "title", 0.5, 310, 190, 560, 215, "true"),
    (1, 1, 0, "table", 0.15, 0, 0, 600, 110, "false"), (3, 0, 0, "title", 0.2, 0, 0, 10, 10, "true"),
)))

WORDS = _values("doc_id, page_index, ordinal, x0, y0, x1, y1, word, block_no, line_no, word_no, width, height", *(f"{d}, {p}, {o}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE), CAST({e} AS DOUBLE), '{w}', {bn}, {ln}, {wn}, CAST({wi} AS DOUBLE), CAST({h} AS DOUBLE)" for d, p, o, a, b, c, e, w, bn, ln, wn, wi, h in (
    (1, 0, 0, 320, 50, 350, 60, "gamma", 0, 0, 0, 600, 800), (1, 0, 1, 360, 50, 390, 60, "delta", 0, 0, 1, 600, 800), (1, 0, 2, 50, 50, 90, 60, "Alpha", 1, 0, 0, 600, 800),
    (1, 0, 3, 50, 70, 90, 80, "beta.", 1, 1, 0, 600, 800), (1, 0, 4, 95, 50, 120, 60, "Don’’t", 1, 0, 1, 600, 800), (1, 0, 5, 280, 300, 320, 310, "mid", 2, 0, 0, 600, 800), (1, 0, 6, 130, 50, 140, 60, "--", 1, 0, 2, 600, 800),
    (1, 1, 0, 50, 20, 90, 30, "lower", 1, 0, 0, 600, 800), (1, 1, 1, 50, 10, 90, 15, "upper", 0, 0, 0, 600, 800), (2, 0, 0, 1, 2, 3, 4, "zero", 0, 0, 0, 0, 0),
)))

#: Page words in reading order, and chunks to find in them; one letter for a word.
SEQUENCES = {"words": "a x b c a b d e f g h i j k l m a b q c n o p a b c", "chunks": ("a b c", "a b q c", "d e f g h", "z y", "a b x", "n o p a b c", "q c n p", "k l m z z z z z z z")}

TRANSCRIPT = _values("doc_id, seg, pos, word, t0, t1", "1, 0, 0, ' Hello', 0.0, 0.4004", "1, 0, 1, ' world!', 0.4004, 0.9", "1, 1, 0, ' -', 1.0, 1.1", "1, 1, 1, 'Again', NULL, 1.23456", "2, 0, 0, '...', 0.0, 0.1")

FILES = _values("name, mime", "'My Paper (v2).pdf', 'application/pdf'", "'...', 'application/pdf'", "'a/b c:d.PDF', NULL", "'notes.txt', 'text/plain'", "'__x__.tar.gz', NULL")

JOBS = _values("job_id, run_id, status, pdf_path, error, final_mp3, final_wav", *(f"'{j}', {r}, '{s}', '{p}', {e}, {m}, {w}" for j, r, s, p, e, m, w in (
    ("j1", 1, "done", "a.pdf", "NULL", "'a.mp3'", "'a.wav'"), ("j2", 2, "done", "b.pdf", "NULL", "NULL", "'b.wav'"), ("j3", 2, "error", "c.pdf", "'Text is empty'", "NULL", "NULL"), ("j4", 2, "processing", "d.pdf", "NULL", "NULL", "NULL"),
)))

PROGRESS = _values("page_index, page_count, phase, job_id", "0, 4, 'splitting', NULL", "0, 4, 'uploading', NULL", "1, 4, 'processing', 'j1'", "1, 4, 'metadata', 'j1'", "3, 4, 'done', 'j3'", "0, 0, 'processing', NULL", "2, 4, 'odd', NULL")

REQUIREMENTS = _values("job_id, name, present", "1, 'ffmpeg', true", "1, 'voice model', true", "2, 'voice config', false", "2, 'ffmpeg', false", "2, 'voice model', true", "3, 'ffmpeg', CAST(NULL AS BOOLEAN)")

REQUESTS = _values("request_id, pdf_path, upload", "1, 'a.pdf', NULL", "2, '/data/b.pdf', ''", "3, 'none.pdf', NULL", "4, 'a.pdf', 'x.pdf'", "5, NULL, NULL", "6, NULL, 'My Paper (v2).pdf'", "7, '', '...'", "8, '/srv/a.pdf', NULL")

KNOWN = _values("path", "'/srv/a.pdf'", "'/data/b.pdf'", "'/srv/a.pdf'")

#: Bytes in hexadecimal: plain, UTF-8, Latin-1, white space, none.
BYTES = _values("doc_id, h", "CAST(-1 AS BIGINT), '706C61696E'", "CAST(-2 AS BIGINT), 'C3A9743F'", "CAST(-3 AS BIGINT), 'E974E9'", "CAST(-4 AS BIGINT), '200A09'", "CAST(-5 AS BIGINT), ''", "CAST(-6 AS BIGINT), 'FFFE41'")

STATES = _values("job_id, at_ms, status, error", "'a', 0, 'processing', NULL", "'a', 7000, 'done', NULL", "'b', 0, 'processing', NULL", "'b', 3000, 'error', 'Text is empty'", "'b', 9000, 'done', NULL", "'c', 0, 'processing', NULL", "'d', 12001, 'error', NULL", "'e', 0, 'done', NULL")

READS = f"SELECT j.job_id, w.what FROM ({_values('job_id', *(repr(x) for x in ('j1', 'j2', 'j3', 'j9')))}) AS j CROSS JOIN ({_values('what', *(repr(x) for x in ('status', 'metadata', 'highlights', 'audio', 'pdf')))}) AS w"

RESULTS = _values("job_id, status, metadata, highlights, audio", "'j1', 'done', 'm.json', 'h.json', 'a.mp3'", "'j2', 'done', NULL, 'h.json', NULL", "'j3', 'processing', NULL, NULL, NULL")

LAID = _values("doc_id, page_index, ordinal, x0, y0, x1, y1, width, height, txt", *(f"{d}, {p}, {o}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE), CAST({e} AS DOUBLE), CAST(600 AS DOUBLE), CAST(800 AS DOUBLE), '{t}'" for d, p, o, a, b, c, e, t in (
    (1, 0, 0, 320, 200, 550, 240, "Right column"), (1, 0, 1, 50, 200, 280, 240, "Left column"), (1, 0, 2, 52, 100, 280, 130, "Top of the left"), (1, 0, 3, 320, 50, 550, 80, "A figure"), (1, 0, 4, 50, 760, 280, 780, "page 1"),
    (1, 1, 0, 50, 300, 550, 320, "Under a table"), (1, 1, 1, 60, 50, 550, 100, "In a table"), (2, 0, 0, 50, 10, 100, 20, "Running head 1"), (2, 1, 0, 50, 10, 100, 20, "Running head 2"), (2, 1, 1, 50, 300, 500, 340, "Body of a page without regions"),
)))

VIEWS = _values("page_index, x0, y0, x1, y1", *(f"{p}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE), CAST({e} AS DOUBLE)" for p, a, b, c, e in ((0, 0, 0, 612, 792), (1, 612, 0, 0, 792), (2, 5, 5, 5, 5.5), (3, "NULL", "NULL", "NULL", "NULL"), (4, 10, 20, 605, 862))))

SIZES = _values("page_index, width, height", *(f"{p}, CAST({w} AS DOUBLE), CAST({h} AS DOUBLE)" for p, w, h in ((0, 612, 792), (1, 600, 792), (4, 595, 842), (7, 1, 2))))

RESULT_PAGES = _values("doc_id, page_index, page_count, first_start", "1, 0, 5, 0.0", "1, 1, 5, NULL", "2, 0, 0, 0.0", "2, 1, NULL, NULL", "2, 2, 0, 1.5")
