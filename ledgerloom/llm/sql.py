"""SQL for the queries on text that SQL can express."""

_TOKENS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
_SIZE = f"len(regexp_extract_all(text, '{_TOKENS}'))::BIGINT"

# full-width forms lie 0xFEE0 beyond the characters they stand for; SQL has no NFKC, so these, two ligatures and the
# invisible characters that occur are written out
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F) if c != 0x27)
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F) if c != 0x27)
_PLAIN = f"lower(translate(replace(replace(replace(regexp_replace(text, '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ß', 'ss'), '{_WIDE}', '{_NARROW}'))"
_WORDS = f"regexp_extract_all({_PLAIN}, '[\\p{{L}}\\p{{N}}]+')"
_LEAKS = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM eval_item WHERE text IS NOT NULL AND item_id IS NOT NULL),
passages AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS p FROM (SELECT item_id, w, least(12, len(w)) AS n, unnest(range(1, len(w) - least(12, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
windows AS (SELECT doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM passages) WHERE len(w) >= n)),
found AS (SELECT DISTINCT doc_id, item_id FROM windows JOIN passages USING (n, p))"""

ORACLES = {
    "p7_sizes": f"SELECT doc_id, {_SIZE} AS size FROM documents WHERE text IS NOT NULL",
    "p7_placements": f"SELECT doc_id, sum(size)::BIGINT AS size, sum(greatest(1, ceil(size / 1024)))::BIGINT AS parts, true AS in_containers_of_their_own FROM (SELECT doc_id, {_SIZE} AS size FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "p7_containers_against_volume": f"SELECT sum({_SIZE})::BIGINT AS tokens, true AS none_too_full, true AS few_containers FROM documents WHERE text IS NOT NULL",
    "p8_found": f"{_LEAKS} SELECT doc_id, item_id FROM found",
    "p8_leaked_items": f"{_LEAKS} SELECT e.item_id, suite, count(doc_id) AS documents FROM eval_item AS e LEFT JOIN found ON e.item_id = found.item_id GROUP BY ALL",
    "p9_found": f"SELECT doc_id FROM documents WHERE {_SIZE} > 256",
    "p9_covered": f"SELECT doc_id, {_SIZE} AS tokens, true AS pieces_right FROM documents WHERE {_SIZE} > 256",
}
