"""DuckDB SQL with the rows of the registered queries, written independently of the operators."""

from __future__ import annotations

from quire.sources.fixtures import ROOT, SPECS

_WS = r"\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[str]) -> str:
    return "VALUES " + ", ".join(f"({i}, {_quoted(s)})" for i, s in enumerate(rows))


def _int(text: str) -> str:
    d = f"regexp_extract({text}, '^[{_WS}]*([+-]?[0-9]+)', 1)"
    return f"CASE WHEN {d} = '' THEN NULL ELSE coalesce(try_cast({d} AS BIGINT), 9007199254740991) END"


_LIST = "[" + ", ".join(map(_quoted, SPECS)) + "]"


def _chain(p: str, source: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """The steps from the specifications of source (spec_id, spec) to their parts, errors and pages, names prefixed by p."""
    return {
        f"{p}raw_parts": ((source,), f"SELECT spec_id, unnest(p) AS raw, generate_subscripts(p, 1) - 1 AS part_no FROM (SELECT spec_id, string_split(spec, ',') AS p FROM {source})"),
        f"{p}trimmed": ((f"{p}raw_parts",), f"SELECT spec_id, part_no, regexp_replace(regexp_replace(raw, '^[{_WS}]+', ''), '[{_WS}]+$', '') AS part FROM {p}raw_parts"),
        f"{p}numbers": (
            (f"{p}trimmed",),
            f"""SELECT *, contains(part, '-') AS ranged, {_int("string_split(part, '-')[1]")} AS first_page,
            CASE WHEN NOT contains(part, '-') THEN {_int("part")} WHEN string_split(part, '-')[2] = '' THEN 9007199254740991 ELSE {_int("string_split(part, '-')[2]")} END AS last_page FROM {p}trimmed""",
        ),
        f"{p}parts": (
            (f"{p}numbers",),
            f"""SELECT *, first_page IS NULL OR last_page IS NULL OR first_page < 1 OR first_page > last_page AS bad,
            CASE WHEN ranged THEN 'Invalid page range values: ' ELSE 'Invalid page number: ' END || part AS message FROM {p}numbers""",
        ),
        f"{p}spec_errors": ((f"{p}parts",), f"SELECT spec_id, arg_min(message, part_no) AS error FROM {p}parts WHERE bad GROUP BY 1"),
        f"{p}spec_pages": ((f"{p}parts", f"{p}spec_errors"), f"SELECT DISTINCT spec_id, unnest(range(first_page, least(last_page, first_page + 10000) + 1)) AS page FROM {p}parts WHERE spec_id NOT IN (SELECT spec_id FROM {p}spec_errors)"),
    }


# name -> (needs, sql); a query lists what it reads and gets these as WITH clauses in order
_CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "text_lines": ((), "SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"),
    "words": (("text_lines",), "SELECT doc_id, pos, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS wpos FROM (SELECT doc_id, pos, string_split(line, ' ') AS w FROM text_lines)"),
    "runs": (
        ("words",),
        """SELECT doc_id, CAST(pos // 5 + 1 AS INTEGER) AS page, pos * 100000 + wpos AS seq,
        CASE WHEN doc_id % 13 = 0 AND pos % 5 = 2 THEN chr(9) || chr(160) ELSE word || ' ' END AS str,
        CASE WHEN doc_id % 11 = 0 AND wpos = 3 THEN NULL
             ELSE CAST(700 - 20 * (pos % 5) AS DOUBLE) + (wpos % 4) * CAST(0.25 AS DOUBLE) - CAST(0.5 AS DOUBLE) - CASE WHEN doc_id % 7 = 0 THEN 1000 ELSE 0 END END AS y
        FROM words""",
    ),
    "text_items": (
        ("runs",),
        f"""SELECT doc_id, page, y, line FROM (
        SELECT doc_id, page, CAST(floor(y) AS BIGINT) + CASE WHEN y - floor(y) >= 0.5 THEN 1 ELSE 0 END AS y, string_agg(str, '' ORDER BY seq) AS line
        FROM runs WHERE y IS NOT NULL GROUP BY 1, 2, 3) WHERE regexp_matches(line, '[^{_WS}]')""",
    ),
    "doc_pages": ((), "SELECT doc_id, CAST((len(string_split(text, chr(10))) - 1) // 5 + 1 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS num_pages FROM documents"),
    "pages_of": (("doc_pages",), "SELECT doc_id, CAST(unnest(range(1, num_pages + 1)) AS INTEGER) AS page FROM doc_pages"),
    "texts": (("text_items", "pages_of"), "SELECT p.doc_id, p.page, coalesce(t.text, '') AS text FROM pages_of p LEFT JOIN (SELECT doc_id, page, string_agg(line, '' ORDER BY y DESC) AS text FROM text_items GROUP BY 1, 2) t USING (doc_id, page)"),
    "specs": ((), f"SELECT col0 AS spec_id, col1 AS spec FROM ({_values(SPECS)})"),
    **_chain("", "specs"),
    **_chain("own_", "own_specs"),
    "own_specs": ((), f"SELECT doc_id AS spec_id, {_LIST}[doc_id % {len(SPECS)} + 1] || ',' || (n_chars % 9) || '-' || (n_chars % 9 + doc_id % 4) AS spec FROM documents"),
    "targets": (("doc_pages", "spec_pages"), "SELECT d.doc_id, d.num_pages, s.page FROM doc_pages d JOIN spec_pages s ON d.doc_id % 16 = s.spec_id"),
    "chosen": (("targets",), "SELECT doc_id, page FROM targets WHERE page <= num_pages"),
    "arrays": (
        (),
        """SELECT vec_id AS spec_id, CASE WHEN vec_id % 11 = 0 THEN []::DOUBLE[] WHEN vec_id % 3 = 0 THEN list_transform(v, lambda e: floor(abs(e) * 40) + 1)
        WHEN vec_id % 3 = 1 THEN list_transform(v, lambda e: floor(e * 20) + 4) ELSE list_transform(v, lambda e: floor(abs(e) * 20) / 2 + 1) END AS pages
        FROM (SELECT vec_id, CAST(embedding[1:5] AS DOUBLE[]) AS v FROM embeddings)""",
    ),
    "requests": ((), f"SELECT conv_id * 1000 + turn AS src_idx, conv_id // 3 AS doc_id, CASE WHEN turn % 7 <> 3 THEN (conv_id + 5 * turn) % {len(SPECS)} END AS spec_id FROM conversations"),
    "request_pages": (
        ("requests", "spec_pages", "doc_pages"),
        """SELECT r.src_idx, r.doc_id, s.page FROM requests r JOIN spec_pages s USING (spec_id) JOIN doc_pages d USING (doc_id) WHERE s.page <= d.num_pages
        UNION ALL SELECT src_idx, doc_id, unnest(range(1, num_pages + 1)) FROM requests JOIN doc_pages USING (doc_id) WHERE spec_id IS NULL""",
    ),
    "logo_images": (
        (),
        """SELECT vec_id % 200 AS doc_id, 1 AS page, CAST(vec_id // 200 AS INTEGER) AS index, 8 AS width, 8 AS height, CAST(1 + label % 3 AS INTEGER) AS kind, CASE label % 3 WHEN 0 THEN 1 WHEN 2 THEN 4 ELSE 3 END AS step,
        CASE WHEN vec_id % 4 <> 0 THEN list_transform(range(1, 257), lambda i: CAST((label * 37 + i * 7) % 256 AS INTEGER)) ELSE list_transform(embedding, lambda e: CAST(floor(abs(CAST(e AS DOUBLE)) * 255) AS INTEGER)) END AS data FROM embeddings""",
    ),
    "checked": (("arrays",), "SELECT spec_id, pages, len(pages) > 0 AND len(list_filter(pages, lambda p: p < 1 OR p <> floor(p))) = 0 AS valid FROM arrays"),
    "objects": (
        (),
        """SELECT vec_id AS v, CASE WHEN vec_id % 6 = 0 THEN 'g_' ELSE 'img_' END || vec_id AS name, vec_id % 200 AS doc_id,
        CASE WHEN vec_id % 12 = 0 THEN 'common' ELSE 'page' END AS scope, CASE WHEN vec_id % 19 <> 0 THEN 8 END AS width, 8 AS height,
        CASE WHEN vec_id % 4 <> 0 THEN CAST(vec_id % 4 AS INTEGER) END AS kind,
        CASE WHEN vec_id % 23 <> 0 THEN list_transform(embedding, lambda e: CAST(floor(abs(CAST(e AS DOUBLE)) * 255) AS INTEGER)) END AS data
        FROM embeddings WHERE vec_id % 29 <> 0""",
    ),
    "painted": (
        (),
        """SELECT doc_id, page, op_pos, obj_name, y, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY op_pos) - 1 AS INTEGER) AS index FROM (
        SELECT vec_id % 200 AS doc_id, 1 AS page, vec_id // 200 AS op_pos,
        CASE WHEN vec_id % 17 <> 0 THEN CASE WHEN vec_id % 6 = 0 THEN 'g_' ELSE 'img_' END || vec_id END AS obj_name,
        CASE WHEN vec_id % 4 <> 0 THEN CAST(700 - 20 * (vec_id % 5) AS DOUBLE) END AS y
        FROM embeddings WHERE vec_id % 5 <> 4)""",
    ),
    "resolved": (
        ("painted", "objects"),
        """SELECT p.*, CASE WHEN c.v IS NOT NULL THEN 'common' WHEN o.v IS NOT NULL THEN 'page' END AS origin,
        CASE WHEN c.v IS NOT NULL THEN c.width ELSE o.width END AS width, CASE WHEN c.v IS NOT NULL THEN c.height ELSE o.height END AS height,
        CASE WHEN c.v IS NOT NULL THEN c.kind ELSE o.kind END AS kind, CASE WHEN c.v IS NOT NULL THEN c.data ELSE o.data END AS data
        FROM painted p LEFT JOIN objects c ON c.scope = 'common' AND starts_with(p.obj_name, 'g_') AND c.doc_id = p.doc_id AND c.name = p.obj_name
        LEFT JOIN objects o ON o.scope = 'page' AND o.doc_id = p.doc_id AND o.name = p.obj_name WHERE p.obj_name IS NOT NULL""",
    ),
    "usable": (("resolved",), "SELECT *, CASE kind WHEN 1 THEN 'grayscale' WHEN 3 THEN 'rgba' ELSE 'rgb' END AS format, CASE kind WHEN 1 THEN 1 WHEN 3 THEN 4 ELSE 3 END AS step, coalesce(CAST(floor(y + 0.5) AS BIGINT), 0) AS image_y FROM resolved WHERE data IS NOT NULL AND width <> 0 AND height <> 0"),
    "mixed": (("text_items", "usable"), "SELECT doc_id, page, 'text' AS type, y, 0 AS k, line AS text, NULL::INTEGER AS index FROM text_items UNION ALL SELECT doc_id, page, 'image', image_y, index, NULL, index FROM usable"),
    "ordered": (("mixed",), "SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC, type DESC, k) AS INTEGER) AS item_ord FROM mixed"),
    "failed_pages": (("doc_pages",), "SELECT doc_id, 2 AS page, 'Error processing page: Failed to get page 2' AS text FROM doc_pages WHERE doc_id % 31 = 5 AND num_pages >= 2"),
    "sources": (
        (),
        f"""SELECT page_id AS src_idx, CASE WHEN page_id % 5 IN (1, 2) THEN 'docs/' || page_id || '.pdf'
        WHEN page_id % 5 = 4 THEN ['../x.pdf', '/abs/x.pdf', 'a/../b/./c.pdf', '', '../root-sibling/x.pdf'][page_id // 5 % 5 + 1] END AS path,
        CASE WHEN page_id % 5 IN (0, 2) THEN url END AS url, page_id % 16 AS spec_id FROM pages""",
    ),
    "confined": (
        ("sources",),
        f"""SELECT *, CASE WHEN path IS NULL THEN 'missing' WHEN starts_with(path, '/') THEN 'absolute' WHEN folded = '{ROOT}' OR starts_with(folded, '{ROOT}/') THEN 'ok' ELSE 'traversal' END AS status FROM (
        SELECT *, list_reduce(list_prepend('{ROOT}', string_split(path, '/')), lambda a, s: CASE WHEN s IN ('', '.') THEN a WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || s END) AS folded FROM sources)""",
    ),
    "there": (("confined",), "SELECT DISTINCT folded AS path FROM confined WHERE status = 'ok' AND src_idx % 4 <> 1"),
    "outcome": (
        ("confined", "there", "spec_errors"),
        """SELECT src_idx, coalesce(path, url, 'unknown source') AS source, CASE
        WHEN e.error IS NOT NULL THEN 'MCP error -32602: Invalid page specification for source ' || coalesce(path, url, 'unknown source') || ': ' || e.error
        WHEN coalesce(path, '') = '' AND coalesce(url, '') = '' THEN 'MCP error -32602: Source ' || coalesce(path, url, 'unknown source') || ' missing ''path'' or ''url''.'
        WHEN path <> '' AND status = 'absolute' THEN 'MCP error -32602: Absolute paths are not allowed.'
        WHEN path <> '' AND status = 'traversal' THEN 'MCP error -32600: Path traversal detected. Access denied.'
        WHEN path <> '' AND folded NOT IN (SELECT path FROM there) THEN 'MCP error -32600: File not found at ''' || path || '''.' END AS error
        FROM confined c LEFT JOIN spec_errors e USING (spec_id)""",
    ),
}

_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": (("text_items",), "SELECT doc_id, page, y, line FROM text_items"),
    "page_texts": (("texts",), "SELECT doc_id, page, text FROM texts"),
    "full_text": (("texts",), "SELECT doc_id, count(*) AS num_pages, string_agg(text, chr(10) || chr(10) ORDER BY page) AS full_text FROM texts GROUP BY 1"),
    "stream_page_texts": (("runs", "pages_of"), "SELECT p.doc_id, p.page, coalesce(t.text, '') AS text FROM pages_of p LEFT JOIN (SELECT doc_id, page, string_agg(str, '' ORDER BY seq) AS text FROM runs GROUP BY 1, 2) t USING (doc_id, page)"),
    "reading_order": (("ordered",), "SELECT doc_id, page, item_ord, type, y FROM ordered"),
    "page_contents": (("ordered",), "SELECT doc_id, page, item_ord, type, text, index FROM ordered"),
    "content_parts": (
        ("ordered", "failed_pages"),
        """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, item_ord) AS ord, type, text, CASE WHEN type = 'image' THEN 'image/png' END AS mime_type FROM (
        SELECT doc_id, page, item_ord, type, text FROM ordered o WHERE NOT EXISTS (SELECT 1 FROM failed_pages f WHERE f.doc_id = o.doc_id AND f.page = o.page)
        UNION ALL SELECT doc_id, page, 1, 'text', text FROM failed_pages) WHERE type = 'image' OR length(text) > 0""",
    ),
    "range_parts": (("own_parts",), "SELECT spec_id, CAST(part_no AS INTEGER) AS part_no, CASE WHEN bad THEN 'error' ELSE 'ok' END AS status, CASE WHEN NOT bad THEN first_page END AS start_page, CASE WHEN NOT bad THEN least(last_page, first_page + 10000) END AS end_page FROM own_parts"),
    "range_pages": (("own_spec_pages",), "SELECT spec_id, page FROM own_spec_pages"),
    "range_errors": (("own_spec_errors",), "SELECT spec_id, 'Invalid page specification for source doc-' || spec_id || ': ' || error AS error FROM own_spec_errors"),
    "array_spec_pages": (("checked",), "SELECT DISTINCT spec_id, CAST(unnest(pages) AS BIGINT) AS page FROM checked WHERE valid"),
    "array_spec_valid": (("checked",), "SELECT spec_id, valid, CASE WHEN len(pages) = 0 THEN 'Page specification resulted in an empty set of pages.' WHEN NOT valid THEN 'Page numbers in array must be positive integers.' END AS error FROM checked"),
    "spec_charset": (
        (),
        f"""SELECT spec_id, length(spec) > 0 AND regexp_matches(regexp_replace(spec, '[{_WS}]+', '', 'g'), '^[0-9,-]+$') AS valid FROM (
        SELECT page_id AS spec_id, CASE WHEN page_id % 13 = 0 THEN '' WHEN page_id % 3 = 0 THEN regexp_replace(url, '[^0-9-]', '', 'g') || ', 1' WHEN page_id % 3 = 1 THEN substring(url, 1, 12) ELSE {_LIST}[page_id % {len(SPECS)} + 1] END AS spec FROM pages)""",
    ),
    "selected_pages": (("chosen",), "SELECT doc_id, page FROM chosen"),
    "invalid_pages": (("targets",), "SELECT doc_id, page FROM targets WHERE page > num_pages"),
    "warnings": (("targets",), "SELECT doc_id, 'Requested page numbers ' || string_agg(CAST(page AS VARCHAR), ', ' ORDER BY page) || ' exceed total pages (' || any_value(num_pages) || ').' AS warning FROM targets WHERE page > num_pages GROUP BY doc_id"),
    "all_pages": (("pages_of",), "SELECT doc_id, page FROM pages_of"),
    "page_count": (("doc_pages",), "SELECT doc_id, num_pages FROM doc_pages"),
    "metadata": ((), "SELECT doc_id, key, value FROM (SELECT doc_id, unnest([lang, source, CAST(n_chars AS VARCHAR)]) AS value, unnest(['lang', 'source', 'n_chars']) AS key FROM documents) WHERE doc_id % 17 <> 0"),
    "source_label": (("sources",), "SELECT src_idx, coalesce(path, url, 'unknown source') AS source FROM sources"),
    "source_exclusive": (("sources",), "SELECT src_idx, (coalesce(path, '') <> '') <> (coalesce(url, '') <> '') AS valid, CASE WHEN (coalesce(path, '') <> '') = (coalesce(url, '') <> '') THEN 'Each source must have either ''path'' or ''url'', but not both.' END AS message FROM sources"),
    "source_kind": (("sources",), "SELECT src_idx, CASE WHEN coalesce(path, '') <> '' THEN 'file' WHEN regexp_matches(lower(url), '^https?://[^/\\s]+') THEN 'url' WHEN coalesce(url, '') <> '' THEN 'refused_url' ELSE 'missing' END AS kind FROM sources"),
    "path_status": (("confined",), "SELECT src_idx, status, CASE WHEN status = 'ok' THEN folded END AS resolved FROM confined"),
    "missing_files": (("confined", "there"), "SELECT src_idx, 'File not found at ''' || path || '''.' AS error FROM confined WHERE status = 'ok' AND folded NOT IN (SELECT path FROM there)"),
    "source_results": (("outcome",), "SELECT src_idx, source, error IS NULL AS success, error FROM outcome"),
    "results_json": (("outcome",), "SELECT src_idx, '{\"source\":\"' || source || '\",\"success\":' || CASE WHEN error IS NULL THEN 'true' ELSE 'false,\"error\":\"' || error || '\"' END || '}' AS json FROM outcome"),
    "answers_json": (
        ("outcome",),
        """SELECT src_idx // 10 AS batch, '{' || chr(10) || '  "results": [' || chr(10) || string_agg('    {' || chr(10) || '      "source": "' || source || '",' || chr(10) || '      "success": '
        || CASE WHEN error IS NULL THEN 'true' ELSE 'false,' || chr(10) || '      "error": "' || error || '"' END || chr(10) || '    }', ',' || chr(10) ORDER BY src_idx) || chr(10) || '  ]' || chr(10) || '}' AS answer
        FROM outcome GROUP BY 1""",
    ),
    "paint_ordinals": (("painted",), "SELECT doc_id, page, op_pos, index FROM painted"),
    "image_resolution": (("resolved",), "SELECT doc_id, page, index, origin FROM resolved"),
    "valid_images": (("usable",), "SELECT doc_id, page, index, width, height FROM usable"),
    "image_info": (("usable",), "SELECT doc_id, page, index, width, height, format FROM usable"),
    "image_only": (("usable",), "SELECT doc_id, page, index, format FROM usable"),
    "image_y": (("painted",), "SELECT doc_id, page, index, coalesce(CAST(floor(y + 0.5) AS BIGINT), 0) AS y FROM painted"),
    "pixel_stats": (("usable",), "SELECT doc_id, page, index, CAST(width * height * 4 AS BIGINT) AS n_bytes, CAST(CASE WHEN step = 1 THEN 3 ELSE 1 END * list_sum(data[1:width * height * step]) + CASE WHEN step = 4 THEN 0 ELSE 255 * width * height END AS BIGINT) AS byte_sum FROM usable"),
    "png_pixels": (("usable",), "SELECT doc_id, page, index, width, height, CAST(width * height * 4 AS BIGINT) AS n_bytes, CAST(CASE WHEN step = 1 THEN 3 ELSE 1 END * list_sum(data[1:width * height * step]) + CASE WHEN step = 4 THEN 0 ELSE 255 * width * height END AS BIGINT) AS byte_sum FROM usable"),
    "page_errors": (("failed_pages",), "SELECT doc_id, page, text FROM failed_pages"),
    "pdf_page_texts": (("texts",), "SELECT doc_id, page, text FROM texts"),
    "pdf_page_count": (("doc_pages",), "SELECT doc_id, num_pages FROM doc_pages"),
    "pdf_first_pages": (("texts",), "SELECT doc_id, page, text FROM texts WHERE page BETWEEN 2 AND 3"),
    "pdf_parted_texts": (("texts",), "SELECT doc_id, page, text FROM texts"),
    "shared_page_texts": (("request_pages", "texts"), "SELECT r.src_idx, t.page, t.text FROM request_pages r JOIN texts t ON t.doc_id = r.doc_id AND t.page = r.page"),
    "shared_decodings": (("request_pages",), "SELECT doc_id, CAST(page AS INTEGER) AS page, 1 AS decodings FROM request_pages GROUP BY 1, 2"),
    "asked_ranges": (
        ("request_pages",),
        """SELECT doc_id, min(page) AS first, max(page) AS last FROM (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS island FROM (SELECT DISTINCT doc_id, page FROM request_pages)) GROUP BY doc_id, island""",
    ),
    "typed_metadata": (
        (),
        """SELECT doc_id, 'lang' AS key, 'STRING' AS kind, '"' || lang || '"' AS value FROM documents WHERE doc_id % 17 <> 0 UNION ALL SELECT doc_id, 'n_chars', 'BIGINT', CAST(n_chars AS VARCHAR) FROM documents WHERE doc_id % 17 <> 0
        UNION ALL SELECT doc_id, 'is_long', 'BOOLEAN', CAST(n_chars > 1000 AS VARCHAR) FROM documents WHERE doc_id % 17 <> 0 UNION ALL SELECT doc_id, 'tags', 'ARRAY<STRING>', '["' || source || '","' || lang || '"]' FROM documents WHERE doc_id % 17 <> 0""",
    ),
    "image_dictionary": (
        ("logo_images",),
        "SELECT md5(list_aggregate(list_transform(data, lambda x: printf('%02X', x)), 'string_agg', '') || ':' || width || ':' || height || ':' || kind) AS key, count(*) AS placements, width, height, kind FROM logo_images GROUP BY key, width, height, kind",
    ),
    "shared_pngs": (
        ("logo_images",),
        "SELECT doc_id, page, index, width, height, CAST(width * height * 4 AS BIGINT) AS n_bytes, CAST(CASE WHEN step = 1 THEN 3 ELSE 1 END * list_sum(data[1:width * height * step]) + CASE WHEN step = 4 THEN 0 ELSE 255 * width * height END AS BIGINT) AS byte_sum FROM logo_images",
    ),
    "ordered_sink": (
        ("ordered", "failed_pages"),
        """SELECT doc_id, ord, type, text, mime_type, row_number() OVER (ORDER BY doc_id, ord) AS position FROM (
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, item_ord) AS ord, type, text, CASE WHEN type = 'image' THEN 'image/png' END AS mime_type FROM (
        SELECT doc_id, page, item_ord, type, text FROM ordered o WHERE NOT EXISTS (SELECT 1 FROM failed_pages f WHERE f.doc_id = o.doc_id AND f.page = o.page)
        UNION ALL SELECT doc_id, page, 1, 'text', text FROM failed_pages) WHERE type = 'image' OR length(text) > 0)""",
    ),
    "batch_mixed": (("texts", "chosen"), "SELECT t.doc_id AS src_idx, 'pages' AS mode, t.page, t.text FROM texts t JOIN chosen c ON c.doc_id = t.doc_id AND c.page = t.page WHERE t.doc_id % 2 = 0 UNION ALL SELECT doc_id, 'full_text', page, text FROM texts WHERE doc_id % 2 = 1"),
}


def _with(needs: tuple[str, ...]) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for below in _CTE[name][0]:
            visit(below)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    return "WITH " + ",\n".join(f"{name} AS ({_CTE[name][1]})" for name in order) + "\n" if order else ""


def oracle_sql() -> dict[str, str]:
    return {name: _with(needs) + sql for name, (needs, sql) in _SQL.items()}
