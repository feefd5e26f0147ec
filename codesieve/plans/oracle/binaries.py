"""SQL twins of files as bytes: blobs built and read unit by unit, in hex."""

from __future__ import annotations

from codesieve.plans.oracle.sources import q
from codesieve.rulebook import files as T
from codesieve.sources.raw_files import EXTENSIONS

CHARS = "string_split({0}, '')"
#: A character as UTF-16 units, high byte first; the low byte first form swaps each unit's halves.
BIG = "list_transform(" + CHARS + ", lambda c: CASE WHEN ord(c) < 65536 THEN printf('%04X', ord(c)) ELSE printf('%04X%04X', 55296 + ((ord(c) - 65536) >> 10), 56320 + ((ord(c) - 65536) & 1023)) END)"
LITTLE = "regexp_replace(array_to_string(" + BIG + ", ''), '(..)(..)', '\\2\\1', 'g')"
NARROW = "array_to_string(list_transform(" + CHARS + ", lambda c: printf('%02X', CASE WHEN ord(c) < 256 THEN ord(c) ELSE 63 END)), '')"
TEXT = "('# ' || chr(119070) || chr(13) || chr(10) || text)"
RAW_CTE = f"""raw AS MATERIALIZED (SELECT 'raw/f' || doc_id || {str(EXTENSIONS)}[doc_id // 8 % {len(EXTENSIONS)} + 1] AS path, CASE doc_id % 8
 WHEN 0 THEN hex(encode({TEXT})) WHEN 1 THEN 'EFBBBF' || hex(encode({TEXT})) WHEN 2 THEN 'FFFE' || {LITTLE.format(TEXT)} WHEN 3 THEN 'FEFF' || array_to_string({BIG.format(TEXT)}, '')
 WHEN 4 THEN {NARROW.format("('# ' || chr(233) || chr(13) || text)")} WHEN 5 THEN '89504E470D0A1A0A' || hex(encode(text))
 WHEN 6 THEN upper(repeat(sha256(text), (doc_id % 5 + 1)::INTEGER)) || repeat('00', (doc_id % 7)::INTEGER) ELSE repeat('010261', (doc_id % 400)::INTEGER) END AS h FROM documents)"""
PAIRS = "regexp_extract_all({0}, '..')"
UTF8 = "regexp_matches({0}, '^(?:[0-7].|C[2-9A-F][89AB].|D.[89AB].|E0[AB].[89AB].|E[1-9ABCEF][89AB].[89AB].|ED[89].[89AB].|F0[9AB].[89AB].[89AB].|F[123][89AB].[89AB].[89AB].|F48.[89AB].[89AB].)*$')"
UNITS = {"LITTLE": "(?:..(?:[0-9A-CEF].|D[0-7])|..D[89AB]..D[C-F])*", "BIG": "(?:(?:[0-9A-CEF].|D[0-7])..|D[89AB]..D[C-F]..)*"}
WIDE = f"""(CASE WHEN starts_with(h, 'FEFF') THEN regexp_matches(substr(h, 5), '^{UNITS["BIG"]}$') WHEN starts_with(h, 'FFFE') THEN regexp_matches(substr(h, 5), '^{UNITS["LITTLE"]}$')
 ELSE regexp_matches(h, '^{UNITS["LITTLE"]}$') END)"""
BINARY_NAMES = "'" + "', '".join(T.BINARY_EXTENSIONS) + "'"
SIGNATURE = " OR ".join(f"starts_with(h, {q(s)})" for s in T.BINARY_HEADERS)
COUNT = "len(list_filter(" + PAIRS.format("head") + ", lambda b: {0}))"
CONTROL = "b < '20' AND b NOT IN ('09', '0A', '0D')"
UNPRINTED = "b <= '08' OR b BETWEEN '0E' AND '1B' OR b BETWEEN '7F' AND '84' OR b BETWEEN '86' AND '9F' OR b = 'AD'"
#: A text of hex units as characters.
SINGLE = "array_to_string(list_transform(" + PAIRS.format("{0}") + ", lambda b: chr(('0x' || b)::INTEGER)), '')"
UNITS_TEXT = """array_to_string(list_transform(regexp_extract_all({0}, 'D[89AB]..D[C-F]..|....'), lambda u: CASE WHEN len(u) = 4 THEN chr(('0x' || u)::INTEGER)
 ELSE chr(65536 + ((('0x' || left(u, 4))::INTEGER - 55296) << 10) + ('0x' || right(u, 4))::INTEGER - 56320) END), '')"""


def sql() -> dict[str, str]:
    swapped = lambda x: f"regexp_replace({x}, '(..)(..)', '\\2\\1', 'g')"
    sniff = f"""WITH {RAW_CTE}, heads AS (SELECT path, h, left(h, 1024) AS head, regexp_extract(path, '\\.[^.]*$') AS ext FROM raw),
 r AS (SELECT path, CASE WHEN ext IN ({BINARY_NAMES}) THEN 'extension' WHEN {SIGNATURE} THEN 'signature' WHEN head = '' THEN NULL
  WHEN {COUNT.format(CONTROL)} > 0.3 * (len(head) // 2) THEN 'control' WHEN {UTF8.format('head')} THEN NULL
  WHEN len(head) // 2 - {COUNT.format(UNPRINTED)} > 0.7 * (len(head) // 2) THEN NULL ELSE 'encoding' END AS reason FROM heads)
SELECT path, reason IS NOT NULL AS is_binary, reason FROM r"""
    chain = f"""WITH {RAW_CTE}, k AS (SELECT path, h, CASE WHEN {UTF8.format('h')} THEN 'utf-8' WHEN {WIDE} THEN 'utf-16' ELSE 'latin-1' END AS encoding FROM raw),
 t AS (SELECT path, encoding, CASE encoding WHEN 'utf-8' THEN decode(unhex(CASE WHEN starts_with(h, 'EFBBBF') THEN substr(h, 7) ELSE h END))
  WHEN 'latin-1' THEN {SINGLE.format('h')}
  ELSE CASE WHEN starts_with(h, 'FEFF') THEN {UNITS_TEXT.format('substr(h, 5)')} WHEN starts_with(h, 'FFFE') THEN {UNITS_TEXT.format(swapped('substr(h, 5)'))} ELSE {UNITS_TEXT.format(swapped('h'))} END END AS content FROM k),
 n AS (SELECT path, encoding, regexp_replace(content, '\\r\\n?', chr(10), 'g') AS content FROM t)
SELECT path, encoding, len(content)::INTEGER AS n_chars, md5(content) AS digest FROM n"""
    return {"binary_sniff": sniff, "decode_chain": chain}
