"""The subpackage's queries by name, with SQL where SQL can say it."""

from __future__ import annotations

from sizelake.llm import consistent_text, context_packing, eval_leaks, natural_split, personal_data, related_splits

QUERIES = {
    "p2_found": related_splits.p2_found,
    "p2_splits": related_splits.p2_splits,
    "p3_found": consistent_text.p3_found,
    "p3_forms": consistent_text.p3_forms,
    "p5_found": natural_split.p5_found,
    "p5_pieces": natural_split.p5_pieces,
    "p6_contexts": context_packing.p6_contexts,
    "p6_fill": context_packing.p6_fill,
    "p7_found": eval_leaks.p7_found,
    "p7_leaks": eval_leaks.p7_leaks,
    "p8_found": personal_data.p8_found,
    "p8_redacted": personal_data.p8_redacted,
}
# fixed values, written out apart from the operator's own tables, as arguments of translate(): full-width signs, blanks, letters
# drawn alike, signs drawn as nothing; accents are composed afterwards
_WIDE = "！＂＃＄％＆＇（）＊＋，－．／０１２３４５６７８９：；＜＝＞？＠ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ［＼］＾＿｀ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ｛｜｝～"
_NARROW = "!\"#$%&'()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_`abcdefghijklmnopqrstuvwxyz{|}~"
_BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_CYRILLIC, _GREEK = ("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅԌԚԜ", "aeopcyxijshdqwABEKMHOPCTYXIJSGQW"), ("οΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oABEZHIKMNOPTYX")
_NOTHING = "\u00ad\u034f\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
_FROM = _WIDE + _BLANKS + "ÐƉ" + _CYRILLIC[0] + _GREEK[0] + _NOTHING
_TO = _NARROW + " " * len(_BLANKS) + "ĐĐ" + _CYRILLIC[1] + _GREEK[1]


def _look(c: str) -> str:
    quoted = [x.replace("'", "''") for x in (_FROM, _TO)]
    return f"nfc_normalize(translate(replace(replace({c}, chr(1233), 'a' || chr(774)), chr(8056), 'o' || chr(768)), '{quoted[0]}', '{quoted[1]}'))"


def _plain(c: str) -> str:
    return f"lower(strip_accents(nfc_normalize(translate({c}, 'đĐ', 'dD'))))"


_P3 = f"""
WITH q AS (SELECT DISTINCT 'cau_chua' AS field, value_id AS record_id, doc_id, cau_chua AS s FROM gia_tri_so WHERE cau_chua <> '' UNION SELECT DISTINCT 'trich_dan_tai_lieu', nhan_xet_id, doc_id, trich_dan_tai_lieu FROM nhan_xet_dinh_tinh WHERE trich_dan_tai_lieu <> ''),
 e AS (SELECT DISTINCT doc_id, element_index, text FROM elements WHERE text <> ''), qf AS (SELECT *, {_look("s")} AS f FROM q), ef AS (SELECT *, {_look("text")} AS f FROM e)
SELECT DISTINCT field, record_id, qf.doc_id, element_index FROM qf JOIN ef ON qf.doc_id = ef.doc_id AND qf.f = ef.f WHERE qf.s <> ef.text AND qf.f <> ''"""
_P2 = f"""
WITH RECURSIVE d AS (SELECT DISTINCT dossier_id, trim(regexp_replace({_plain("dossier")}, '[\\s_\\-–—/]+', ' ', 'g')) AS n, trim(regexp_replace(regexp_replace({_plain("dau_moi_yeu_cau")}, '\\([^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g')) AS a FROM eval_dossiers WHERE dossier_id IS NOT NULL),
 k AS (SELECT dossier_id, regexp_replace(regexp_replace(n, '^(cap moi he thong|cap moi|cap bo sung|nang cap|ung cuu) ', ''), '( v?[0-9]+(\\.[0-9]+)*)+$', '') AS s,
   CASE WHEN a IN ('', '-', 'n/a', 'chua co', 'khong ro') THEN NULL ELSE replace(split_part(a, '@', 1), ' ', '') END AS r FROM d),
 e AS (SELECT dossier_id, 's:' || s AS key FROM k WHERE s <> '' UNION SELECT dossier_id, 'r:' || r FROM k WHERE r <> ''),
 hop AS (SELECT DISTINCT x.dossier_id AS a, y.dossier_id AS b FROM e x JOIN e y USING (key)),
 reach(a, b) AS (SELECT a, b FROM hop UNION SELECT r.a, h.b FROM reach r JOIN hop h ON h.a = r.b),
 g AS (SELECT a AS dossier_id, min(b) AS group_id FROM reach GROUP BY 1)
SELECT dossier_id, group_id FROM g WHERE group_id IN (SELECT group_id FROM g GROUP BY 1 HAVING count(*) > 1)"""
_WORDS = f"list_filter(regexp_split_to_array(lower(strip_accents(translate({_look('text')}, 'đĐ', 'dD'))), '[^a-z0-9]+'), lambda x: x <> '')"
_P7 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text <> ''), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text <> ''),
 gi AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda p: array_to_string(list_slice(w, p, p + 11), ' '))) AS g FROM i WHERE len(w) >= 12),
 gd AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda p: array_to_string(list_slice(w, p, p + 11), ' '))) AS g FROM d WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM gd JOIN gi USING (g)"""
ORACLE: dict[str, str] = {
    "p5_found": """
        SELECT DISTINCT field, record_id FROM (
          SELECT 'elements.text' AS field, doc_id || '#' || element_index AS record_id, text FROM elements
          UNION ALL SELECT 'project_data.mo_hinh_he_thong_content', id, mo_hinh_he_thong_content FROM project_data
          UNION ALL SELECT 'project_data.dinh_co_he_thong_content', id, dinh_co_he_thong_content FROM project_data
        ) WHERE length(text) > 2000""",
    "p2_found": _P2,
    "p3_found": _P3,
    "p7_found": _P7,
}
