"""DuckDB SQL that gives the rows of operators 11 to 13 by their definitions, not by their methods."""

from __future__ import annotations

from . import sharding

CRC_TABLE = "SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k) ORDER BY k) AS crc_table FROM range(256) r(k)"
NEVER = 1_000_000_000


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, with crc_table of CRC_TABLE in scope."""
    return f"xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def fill_in_middle() -> str:
    """A text is cut at code points that sums of units' lengths give; what is restored is the text itself."""
    number = lambda k: f"('0x' || substr(sha256('1:' || doc_id), {8 * k - 7}, 8))::BIGINT"
    chars = lambda cut: f"coalesce(list_sum(list_transform(units[1:{cut}], lambda u: length(u))), 0)::BIGINT"
    return f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units FROM t),
    h AS (SELECT *, len(units)::BIGINT AS n, {number(1)} % (len(units) + 1) AS x, {number(2)} % (len(units) + 1) AS y,
        CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR {number(3)} % 100 >= 90 THEN 'plain' WHEN {number(4)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
    c AS (SELECT *, {chars("least(x, y)")} AS a, {chars("greatest(x, y)")} AS b FROM h)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
            ELSE '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a) END) AS output_sha256,
        sha256(text) AS restored_sha256 FROM c"""


def _permuted(source: str) -> str:
    """(r, x) of source, x permuted once by the network over 4^half numbers; columns r, x, half, total."""
    sql = f"SELECT r, half, total, x >> half AS a, x & ((1::UHUGEINT << half) - 1) AS b FROM ({source})"
    wide = "18446744073709551616::UHUGEINT"
    for key in sharding._round_keys(0).tolist():
        sql = f"SELECT *, (b + {key}::UHUGEINT) % {wide} AS y FROM ({sql})"
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            sql = f"SELECT r, half, total, a, b, (xor(y, y >> {shift}) * {factor}::UHUGEINT) % {wide} AS y FROM ({sql})"
        sql = f"SELECT r, half, total, b AS a, xor(a, xor(y, y >> 31) & ((1::UHUGEINT << half) - 1)) AS b FROM ({sql})"
    return f"SELECT r, a << half | b AS x, half, total FROM ({sql})"


def shards() -> str:
    """Rows numbered by a window, numbers permuted until they fall within the table."""
    return f"""
    WITH RECURSIVE crcs AS ({CRC_TABLE}),
    t AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce({_crc32("text")}, 0) AS text_crc32 FROM documents, crcs),
    numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS r, count(*) OVER () AS total FROM t),
    walk AS ({_permuted("SELECT r, r::UHUGEINT AS x, ((length(bin(greatest(total - 1, 1))) + 1) // 2)::UHUGEINT AS half, total FROM numbered")}
        UNION ALL {_permuted("SELECT r, x, half, total FROM walk WHERE x >= total::UHUGEINT")}),
    placed AS (SELECT r, x::BIGINT AS p FROM walk WHERE x < total::UHUGEINT)
    SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (p % 16)::INT AS shard, p // 16 AS slot, NULL::INT AS grown_shard FROM numbered JOIN placed USING (r)"""


def _way(cost: str, audit: str, lines: str) -> str:
    return f"struct_pack(c := ({cost})::BIGINT, a := {audit}, o := {lines})"


def _best(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def repairs() -> str:
    """Forward over the rows: of each state the least (cost, audit) with its lines, rows joined one by one."""
    insert = lambda w, role: _way(f"{w}.c + 3", f"{w}.a || 'I'", f"list_append({w}.o, '{role}:')")
    drop = lambda w: _way(f"{w}.c + 4", f"{w}.a || 'D'", f"{w}.o")
    keep = lambda w, initial: _way(f"CASE WHEN initial = '{initial}' AND fault NOT IN ('blank', 'duplicate') THEN {w}.c + mend ELSE {NEVER} END", f"{w}.a || 'K'", f"list_append({w}.o, role || ':' || text)")
    rerole = lambda w, role: _way(f"CASE WHEN fault IN ('blank', 'duplicate') THEN {NEVER} ELSE {w}.c + 3 + mend END", f"{w}.a || 'R'", f"list_append({w}.o, '{role}:' || text)")
    user = _best("b2", insert("b0", "user"), insert("b1", "user"), insert("b3", "user"))
    opened = lambda source: f"SELECT *, {_best('b3', insert('f2', 'assistant'))} AS f3 FROM (SELECT *, {user} AS f2 FROM ({source}))"
    to_user = [f(w, x) for w in ("b0", "b1", "f3") for f, x in ((keep, "u"), (rerole, "user"))]
    nothing = _way("0", "''", "[]::VARCHAR[]")
    never = _way(str(NEVER), "''", "[]::VARCHAR[]")
    return f"""
    WITH RECURSIVE crcs AS ({CRC_TABLE}),
    kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crcs),
    damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM kinds, range(2) copy(k) WHERE kind <> 0 AND (k = 0 OR kind = 3)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS pos FROM damaged),
    faults AS (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS step FROM numbered),
    counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
    steps AS (SELECT *, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS mend FROM faults),
    ways AS (SELECT conv_id, 0::BIGINT AS pos, {nothing} AS b0, {never} AS b1, {never} AS b2, {never} AS b3 FROM counts
        UNION ALL SELECT conv_id, pos, {drop("b0")}, {_best(drop("b1"), keep("b0", "s"))}, {_best(drop("f2"), *to_user)}, {_best(drop("f3"), keep("f2", "a"), rerole("f2", "assistant"))}
        FROM ({opened("SELECT s.conv_id, s.pos, s.role, s.text, s.initial, s.fault, s.mend, w.b0, w.b1, w.b2, w.b3 FROM ways w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.pos = w.pos + 1")})),
    ends AS (SELECT conv_id, {_best("b0", "f3")} AS best FROM ({opened("SELECT w.* FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.pos")})),
    every AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
        coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.o, chr(10)), '')) AS repaired_sha256
    FROM every e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN ends b ON b.conv_id IS NOT DISTINCT FROM e.conv_id"""
