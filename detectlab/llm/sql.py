"""SQL for the operators that SQL can express, over the same tables."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned crc32 of a decimal number or other ASCII text, bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = "(xor(a, b) >> 1) + CASE WHEN xor(a, b) % 2 = 1 THEN xor(xor(a, b) >> 1, 3988292384) - (xor(a, b) >> 1) ELSE 0 END"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {steps}), lambda a, b: {step}), 4294967295)"


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode({f}))::VARCHAR || ':' || {f}, '-')" for f in fields) + "))"


def manifest(levels: int = 5, arity: int = 16) -> str:
    """``levels`` above the leaves of a source, and as many above the subroots."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"d AS (SELECT *, {_leaf('text')} AS leaf, CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_leaf(lower)} ELSE {_leaf('text')} END AS other FROM documents)",
        "leaves AS (SELECT doc_id, leaf, other, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, "
        "row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM d)",
        "s0 AS (SELECT tree, idx, n, leaf AS h FROM leaves)",
    ]

    def climb(name: str) -> None:
        for k in range(levels):
            rest = f"OVER (PARTITION BY tree, idx // {arity} ORDER BY idx ROWS BETWEEN"
            parts.append(f"{name}b{k} AS (SELECT tree, idx, coalesce(string_agg(h, '') {rest} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                         f"coalesce(string_agg(h, '') {rest} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE n > 1)")
            parts.append(f"{name}{k + 1} AS (SELECT tree, idx // {arity} AS idx, (n + {arity - 1}) // {arity} AS n, sha256(string_agg(h, '' ORDER BY idx)) AS h "
                         f"FROM {name}{k} WHERE n > 1 GROUP BY ALL)")
        parts.append(f"{name}top AS (" + " UNION ALL ".join(f"SELECT tree, h FROM {name}{k} WHERE n = 1" for k in range(levels + 1)) + ")")

    climb("s")
    parts.append("t0 AS (SELECT 0 AS tree, tree AS idx, count(*) OVER () AS n, h FROM stop)")
    climb("t")
    last = "f0 AS (SELECT *, '' AS siblings, other AS folded FROM leaves)"
    parts.append(last)
    steps = [(f"sb{k}", "f.tree", f"f.idx // {arity**k}") for k in range(levels)] + [(f"tb{k}", "0", f"f.tree // {arity**k}") for k in range(levels)]
    for k, (beside, tree, idx) in enumerate(steps):
        parts.append(f"f{k + 1} AS (SELECT f.doc_id, f.leaf, f.other, f.tree, f.idx, f.siblings || coalesce(b.l || b.r, '') AS siblings, "
                     f"CASE WHEN b.l IS NULL THEN f.folded ELSE sha256(b.l || f.folded || b.r) END AS folded "
                     f"FROM f{k} f LEFT JOIN {beside} b ON b.tree = {tree} AND b.idx = {idx})")
    return (f"WITH {', '.join(parts)} SELECT doc_id, leaf, stop.h AS subroot, ttop.h AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, "
            f"folded = ttop.h AS verified FROM f{len(steps)} f JOIN stop ON stop.tree = f.tree CROSS JOIN ttop")


def _plus(value: str, cost: int, letter: str) -> str:
    """Cost (six digits) and audit in one text, so that the least text is the cheapest and then the ASCII-least."""
    return f"lpad(CAST(CAST(left({value}, 6) AS INTEGER) + {cost} AS VARCHAR), 6, '0') || substr({value}, 7) || '{letter}'"


def repair() -> str:
    """Rows one after the other, with the best (cost, audit) of each state; then the audit is walked to make the lines."""
    # States: c0 nothing yet, c1 after system, c2 after user, c3 after assistant.
    put = lambda c: {2: f"least({c}2, {_plus(c + '0', 5, 'I')}, {_plus(c + '1', 5, 'I')}, {_plus(c + '3', 5, 'I')})",
                     3: f"least({c}3, {_plus(c + '2', 5, 'I')})"}
    one = put("a")
    closed = f"SELECT *, a0 AS b0, a1 AS b1, {one[2]} AS b2, {one[3]} AS b3"
    two = put("b")
    both = f"SELECT *, b0 AS c0, b1 AS c1, {two[2]} AS c2, {two[3]} AS c3"
    extra = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"

    def plus(value: str, cost: str, letter: str) -> str:
        return f"lpad(CAST(CAST(left({value}, 6) AS INTEGER) + {cost} AS VARCHAR), 6, '0') || substr({value}, 7) || '{letter}'"

    stays = "coalesce(fault, '') NOT IN ('blank', 'duplicate')"

    def when(condition: str, value: str, letter: str, cost: str) -> str:
        return f"CASE WHEN {stays} AND {condition} THEN {plus(value, f'{cost} + {extra}', letter)} END"

    def into(kind: str, froms: tuple[int, ...]) -> list[str]:
        return [x for q in froms for x in (when(f"initial = '{kind}'", f"c{q}", "K", "0"), when("true", f"c{q}", "R", "1"))]

    new0 = plus("c0", "2", "D")
    new1 = f"least({plus('c1', '2', 'D')}, {when(chr(39) + 's' + chr(39) + ' = initial', 'c0', 'K', '0')})"
    new2 = f"least({plus('c2', '2', 'D')}, {', '.join(into('u', (0, 1, 3)))})"
    new3 = f"least({plus('c3', '2', 'D')}, {', '.join(into('a', (2,)))})"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    return (
        f"WITH RECURSIVE p AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32(key)} % 20 AS f FROM conversations), "
        "q AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN "
        "regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM p), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(role))::VARCHAR || ':' || role || text), copy) AS i FROM q), "
        "s AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier, CASE "
        "WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' "
        "WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' "
        "WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault FROM r), "
        "ids AS (SELECT DISTINCT conv_id FROM conversations), "
        "walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000' AS a0, CAST(NULL AS VARCHAR) AS a1, CAST(NULL AS VARCHAR) AS a2, CAST(NULL AS VARCHAR) AS a3 FROM ids UNION ALL "
        f"SELECT conv_id, i, {new0} AS a0, {new1} AS a1, {new2} AS a2, {new3} AS a3 FROM ({both} FROM ({closed} FROM "
        "(SELECT w.conv_id, s.i, s.initial, s.fault, a0, a1, a2, a3 FROM walk w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i + 1)))), "
        f"ends AS (SELECT conv_id, i, least(c0, c3) AS best FROM ({both} FROM ({closed} FROM (SELECT * FROM walk QUALIFY i = max(i) OVER (PARTITION BY conv_id))))), "
        # used: rows so far; state as above.
        "lines AS (SELECT conv_id, substr(best, 7) AS audit, 1 AS step, CAST(0 AS BIGINT) AS used, 0 AS state, CAST([] AS VARCHAR[]) AS lines FROM ends UNION ALL "
        "SELECT l.conv_id, audit, step + 1, used + CASE WHEN e = 'I' THEN 0 ELSE 1 END, "
        "CASE WHEN e = 'D' THEN state WHEN e = 'K' THEN CASE s.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END WHEN state = 2 THEN 3 ELSE 2 END, "
        "CASE WHEN e = 'D' THEN lines ELSE list_append(lines, CASE WHEN e = 'K' THEN s.role WHEN state = 2 THEN 'assistant' ELSE 'user' END || ':' || "
        "CASE WHEN e = 'I' THEN '' ELSE s.text END) END FROM (SELECT *, substr(audit, step, 1) AS e FROM lines WHERE step <= length(audit)) l "
        "LEFT JOIN s ON e <> 'I' AND s.conv_id IS NOT DISTINCT FROM l.conv_id AND s.i = l.used + 1), "
        "c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, "
        "count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, "
        "count(*) FILTER (WHERE earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM s GROUP BY conv_id) "
        "SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, "
        "coalesce(illegal, 0) AS illegal, CAST(left(best, 6) AS BIGINT) AS cost, substr(best, 7) AS audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256 "
        "FROM ends e JOIN lines l ON l.conv_id IS NOT DISTINCT FROM e.conv_id AND l.step = length(l.audit) + 1 LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"
    )
