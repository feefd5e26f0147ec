"""Queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from codesieve.llm import (bpe, conversation_repair, decontaminate, exact_dedup, language_id, licence_scan, line_dedup, near_dedup,
                           packing, phrases, quality_rules, secret_scan, url_filter)

Builder = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_registry() -> dict[str, Builder]:
    return {
        "op1_exact_dedup": lambda spark, d: exact_dedup.decisions(table(spark, d, "documents")),
        "op2_quality_rules": lambda spark, d: quality_rules.decisions(table(spark, d, "documents"), table(spark, d, "labels")),
        "op3_minhash": lambda spark, d: near_dedup.link(table(spark, d, "documents")),
        "op4_packing": lambda spark, d: packing.pieces(table(spark, d, "documents")),
        "op5_secrets": lambda spark, d: secret_scan.decisions(table(spark, d, "documents")),
        "op6_url_filter": lambda spark, d: url_filter.judge(table(spark, d, "pages")),
        "op7_licences": lambda spark, d: licence_scan.decisions(table(spark, d, "documents")),
        "op8_bpe": lambda spark, d: bpe.digests(table(spark, d, "documents")),
        "op9_line_dedup": lambda spark, d: line_dedup.decisions(table(spark, d, "documents")),
        "op10_language_id": lambda spark, d: language_id.decisions(table(spark, d, "documents")),
        "op11_decontamination": lambda spark, d: decontaminate.decisions(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op12_conversation_repair": lambda spark, d: conversation_repair.decisions(table(spark, d, "conversations")),
        "op13_phrases": lambda spark, d: phrases.collocations(table(spark, d, "documents")),
    }


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
AFTER = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"
HOST = r"translate(regexp_extract(" + AFTER + r", '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PATH = r"regexp_extract(" + AFTER + r", '^[^/?#]*([^?#]*)', 1)"
QUERY = r"""regexp_replace(regexp_replace(regexp_extract({0}, '^[^?#]*\?([^#]*)', 1),
            '(^|&)(utm_[a-z]+|gclid|fbclid|ref|mc_cid|mc_eid)=[^&]*', '', 'g'), '^&', '')"""
FORM = ("'https://' || regexp_replace(" + HOST + r", '^(www|m)\.', '') || regexp_replace(" + PATH + r", '(/index)?(\.html?)?/*$', '')"
        " || CASE WHEN " + QUERY + " <> '' THEN '?' || " + QUERY + " ELSE '' END")


def _edited(best: str, cost: str, letter: str, line: str) -> str:
    """SQL: a state's cheapest edits so far with one more."""
    return f"CASE WHEN {best} IS NOT NULL THEN {{'c': {best}.c + {cost}, 'a': {best}.a || '{letter}', 't': {best}.t || {line}}} END"


INSERT_USER, INSERT_ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
STATE = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
#: checksum of an ASCII text, bit by bit.
CRC32 = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x %% 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
REPAIR = (r"""
        WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, """ + CRC32.replace("%%", "%").format(
    "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')") + r""" % 20 AS kind FROM conversations),
        x AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                     CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(CASE kind WHEN 0 THEN []::INTEGER[] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM d),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM x),
        f AS (SELECT *, substr(role, 1, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut,
                     row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM o),
        r AS (SELECT *, CASE WHEN cut = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(cut, 1) IN ('.', '!', '?') THEN '' ELSE 'truncated' END AS wrong,
                     lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS met FROM f),
        k AS (SELECT *, wrong IN ('', 'truncated') AS may_stay, CASE wrong WHEN 'truncated' THEN 5 ELSE 0 END AS extra,
                     chr(10) || role || ':' || text AS line, ':' || text AS tail FROM r),
        c AS (SELECT DISTINCT conv_id FROM conversations),
        n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE wrong = 'blank') AS blank,
                     count(*) FILTER (WHERE wrong = 'duplicate') AS duplicate, count(*) FILTER (WHERE wrong = 'truncated') AS truncated,
                     count(*) FILTER (WHERE met NOT IN ('su', 'ua', 'au')) AS illegal FROM k GROUP BY conv_id),
        best(conv_id, i, z, s, u, a) AS (
          SELECT conv_id, 0::BIGINT, {'c': 0, 'a': '', 't': ''}::@, NULL::@, {'c': 5, 'a': 'I', 't': chr(10) || 'user:'}::@, {'c': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}::@ FROM c
          UNION ALL
          SELECT conv_id, i, z, s, u, list_min([a, """ + _edited("u", "5", "I", INSERT_ASSISTANT) + r"""]) FROM (
            SELECT conv_id, i, z, s, a, list_min([u, """ + ", ".join(_edited(b, "5", "I", INSERT_USER) for b in "zsa") + r"""]) AS u FROM (
              SELECT best.conv_id, k.i,
                """ + _edited("best.z", "2", "D", "''") + r""" AS z,
                list_min([""" + _edited("best.s", "2", "D", "''") + ", CASE WHEN may_stay AND initial = 's' THEN " + _edited("best.z", "extra", "K", "line") + r""" END]) AS s,
                list_min([""" + _edited("best.u", "2", "D", "''") + "".join(
    f", CASE WHEN may_stay AND initial = 'u' THEN {_edited('best.' + b, 'extra', 'K', 'line')} END, CASE WHEN may_stay THEN {_edited('best.' + b, 'extra + 1', 'R', "chr(10) || 'user' || tail")} END" for b in "zsa") + r"""]) AS u,
                list_min([""" + _edited("best.a", "2", "D", "''") + ", CASE WHEN may_stay AND initial = 'a' THEN " + _edited("best.u", "extra", "K", "line")
    + " END, CASE WHEN may_stay THEN " + _edited("best.u", "extra + 1", "R", "chr(10) || 'assistant' || tail") + r""" END]) AS a
              FROM best JOIN k ON k.conv_id IS NOT DISTINCT FROM best.conv_id AND k.i = best.i + 1))),
        e AS (SELECT c.conv_id, n.* EXCLUDE (conv_id), list_min([best.z, best.a]) AS b FROM c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
              JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id AND best.i = coalesce(n.n, 0))
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, b.c AS cost, b.a AS audit, sha256(substr(b.t, 2)) AS repaired_sha256 FROM e""")
SQL = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op3_minhash": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(%s, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS shingle FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        reach(node, other) AS (SELECT x, x FROM e UNION SELECT reach.node, e.y FROM reach JOIN e ON reach.other = e.x),
        g AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN g ON g.node = d.doc_id""" % LOWERED,
    "op6_url_filter": r"""
        WITH RECURSIVE p AS (SELECT page_id, url, html, %s AS host, %s AS path FROM (SELECT page_id, coalesce(url, '') AS url, html FROM pages)),
        r AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                             WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                             WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                             WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
        k AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS own FROM r),
        named AS (SELECT url, regexp_extract(url, '^([^/?#]*://[^/?#]*)', 1) AS origin, unnest([
                    regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
                    regexp_extract(html, '(?is)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*\brel\s*=\s*["'']?canonical\b', 1),
                    regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS target
                  FROM p WHERE instr(url, '://') > 0),
        aimed AS (SELECT url, CASE WHEN instr(target, '://') > 0 THEN target WHEN starts_with(target, '/') THEN origin || target END AS target FROM named WHERE target <> ''),
        e AS (SELECT url AS u, %s AS v FROM p WHERE instr(url, '://') > 0
              UNION SELECT %s AS u, %s AS v FROM aimed WHERE target IS NOT NULL),
        both_ways AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v),
        reach(node, other) AS (SELECT u, u FROM both_ways UNION SELECT reach.node, b.v FROM reach JOIN both_ways b ON reach.other = b.u),
        grp AS (SELECT node, min(other) AS alias_group FROM reach GROUP BY node),
        g AS (SELECT k.*, grp.alias_group FROM k LEFT JOIN grp ON k.url = grp.node),
        known AS (SELECT alias_group, bool_or(own = 'allow') AS allowed, bool_or(own = 'block') AS blocked FROM g WHERE own IS NOT NULL AND alias_group IS NOT NULL GROUP BY alias_group)
        SELECT page_id, host, path, rule, coalesce(own, CASE WHEN blocked AND NOT allowed THEN 'block' ELSE 'allow' END) AS verdict, g.alias_group
        FROM g LEFT JOIN known ON g.alias_group = known.alias_group""" % (
        HOST.format("url"), PATH.format("url"), FORM.format("url"), FORM.format("url"), FORM.format("target")),
    "op9_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        x AS (SELECT rid, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d),
        l AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM x),
        c AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
        m AS (SELECT l.*, c.k IS NOT NULL AND l.doc_id <> c.top AS gone FROM l LEFT JOIN c ON l.k = c.k)
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY rid""",
    "op11_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(%s, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array(%s, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        n AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
        g AS (SELECT DISTINCT item_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS words FROM n),
        s AS (SELECT DISTINCT size FROM g),
        p AS (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, s),
        m AS (SELECT rid, i, p.size, item_id FROM p JOIN g ON g.size = p.size AND g.words = array_to_string(w[i:i + p.size - 1], ' ')),
        h AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS place FROM m) GROUP BY rid),
        t AS (SELECT rid, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT rid, item_id::VARCHAR AS name FROM m WHERE item_id IS NOT NULL) GROUP BY rid)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h ON h.rid = d.rid LEFT JOIN t ON t.rid = d.rid""" % (LOWERED, LOWERED),
    "op12_conversation_repair": REPAIR.replace("@", STATE),
    "op13_phrases": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(%s, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
        total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
        g AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS s(size)),
        f AS (SELECT lang, phrase, size, count(*) AS a FROM g GROUP BY ALL),
        c AS (SELECT lang, phrase, size, a, string_split(phrase, ' ') AS w FROM f WHERE a >= 10 AND size >= 2),
        longer AS (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE size = 3),
        stay AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM longer WHERE longer.lang = c.lang AND longer.phrase = c.phrase AND 100 * longer.a >= 50 * c.a)),
        cuts AS (SELECT lang, phrase, a, w, unnest(range(1, size)) AS k FROM stay),
        scores AS (SELECT cuts.*, x.a AS l, y.a AS r, (1000000::HUGEINT * cuts.a * cuts.a) // (x.a::HUGEINT * y.a) AS score
                   FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
        best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
        FROM best JOIN total ON total.lang = best.lang QUALIFY rank <= 2000""" % LOWERED,
}
