"""Problem 1 in SQL, to check the operator against: the same decisions, said with regular expressions and joins."""

from __future__ import annotations

# fixed values, written out apart from the operator's own: full-width signs, blanks, letters drawn alike, signs drawn as nothing
_WIDE = "！＂＃＄％＆＇（）＊＋，－．／０１２３４５６７８９：；＜＝＞？＠ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ［＼］＾＿｀ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ｛｜｝～"
_NARROW = "!\"#$%&'()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_`abcdefghijklmnopqrstuvwxyz{|}~"
_BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_ALIKE, _LATIN = "аеорсухіјѕԁԛԝһАВЕКМНОРСТУХІЈЅοΑΒΕΖΗΙΚΜΝΟΡΤΥΧÐƉ", "aeopcyxijsdqwhABEKMHOPCTYXIJSoABEZHIKMNOPTYXĐĐ"
_NOTHING = "\u00ad\u034f\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
_FROM, _TO = _WIDE + _BLANKS + _ALIKE + _NOTHING, _NARROW + " " * len(_BLANKS) + _LATIN


def plain(c: str) -> str:
    a, b = (x.replace("'", "''") for x in (_FROM, _TO))
    return f"trim(regexp_replace(nfc_normalize(translate({c}, '{a}', '{b}')), '\\s+', ' ', 'g'))"


NUM = r"[0-9]+(?: [0-9]{3})+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)*"


def number(c: str) -> str:
    s = f"replace({c}, ' ', '')"
    dots, commas = f"(length({s}) - length(replace({s}, '.', '')))", f"(length({s}) - length(replace({s}, ',', '')))"
    return f"""CASE WHEN {dots} > 0 AND {commas} > 0 THEN CASE WHEN instr(reverse({s}), '.') < instr(reverse({s}), ',') THEN try_cast(replace({s}, ',', '') AS DOUBLE) ELSE try_cast(replace(replace({s}, '.', ''), ',', '.') AS DOUBLE) END
      WHEN {dots} > 1 OR {commas} > 1 THEN try_cast(replace(replace({s}, '.', ''), ',', '') AS DOUBLE)
      WHEN {dots} = 1 AND length(split_part({s}, '.', 2)) = 3 AND ltrim(split_part({s}, '.', 1), '0') <> '' THEN try_cast(replace({s}, '.', '') AS DOUBLE)
      ELSE try_cast(replace({s}, ',', '.') AS DOUBLE) END"""


# spellings that the unit list lacks
EXTRA = """('dung_luong', 'byte', 'kib', false, 1024.0), ('dung_luong', 'byte', 'mib', false, 1048576.0), ('dung_luong', 'byte', 'gib', false, 1073741824.0), ('dung_luong', 'byte', 'tib', false, 1099511627776.0), ('dung_luong', 'byte', 'kbytes', false, 1024.0),
 ('dung_luong', 'byte', 'mbytes', false, 1048576.0), ('dung_luong', 'byte', 'gbytes', false, 1073741824.0), ('dung_luong', 'byte', 'tbytes', false, 1099511627776.0), ('bang_thong', 'bps', 'kbit/s', true, 1e3), ('bang_thong', 'bps', 'Mbit/s', true, 1e6), ('bang_thong', 'bps', 'Gbit/s', true, 1e9),
 ('bang_thong', 'bps', 'Mbit/giây', true, 1e6), ('bang_thong', 'bps', 'Gbit/giây', true, 1e9), ('thoi_gian', 'giay', 'minutes', false, 60.0), ('thoi_gian', 'giay', 'hours', false, 3600.0), ('thoi_gian', 'giay', 'days', false, 86400.0), ('thoi_gian', 'giay', 'months', false, 2592000.0), ('thoi_gian', 'giay', 'years', false, 31536000.0)"""
SCALE = "CASE {0} WHEN 'nghìn' THEN 1e3 WHEN 'ngàn' THEN 1e3 WHEN 'triệu' THEN 1e6 WHEN 'tỷ' THEN 1e9 ELSE 1.0 END"


def side(name: str, key: str, raw: str, beside: str, quote: str, source: str) -> str:
    """CTEs that give {name}(id, doc_id, scope_key, name, amount, dims)."""
    words = ", ".join(f"array_to_string(list_slice(string_split(tail, ' '), 1, {k}), ' ')" for k in (4, 3, 2, 1))
    return f"""
 {name}0 AS (SELECT DISTINCT {key} AS id, doc_id, scope_key, name, replace(regexp_replace({plain(raw)}, '^(~|khoảng )\\s*', ''), 'CINT2017', 'Cint') AS s, trim({plain(beside)}, ' .') AS b, replace({plain(quote)}, 'CINT2017', 'Cint') AS q FROM {source}),
 {name}1 AS (SELECT *, regexp_extract(s, '^({NUM})\\s*(nghìn|ngàn|triệu|tỷ)?\\s*([^0-9]*?)\\s*(?:({NUM})\\s*([^0-9]+))?$', ['n1', 'sc', 'u1', 'n2', 'u2']) AS p FROM {name}0 WHERE regexp_matches(s, '^[0-9]') AND NOT regexp_matches(s, '[0-9]\\s*[-–]\\s*[0-9]')),
 {name}2 AS (SELECT *, trim(regexp_extract(q, '(?:^|[^\\p{{L}}\\p{{N}}_.,–-])' || replace(p.n1, '.', '[.]') || '\\s*(?:nghìn|ngàn|triệu|tỷ)?\\s*([^0-9,;]*)', 1)) AS tail FROM {name}1 WHERE p.n1 <> ''),
 {name}3 AS (SELECT id, doc_id, name, tail, unnest([{words}]) AS w FROM {name}2 WHERE tail <> ''),
 {name}4 AS (SELECT id, doc_id, name, tail, first({{'d': u.dims, 'f': u.f}} ORDER BY length(w) DESC) AS qu FROM {name}3 JOIN u ON u.a = CASE WHEN u.ex THEN trim(w, ' .') ELSE lower(trim(w, ' .')) END GROUP BY ALL),
 {name}5 AS (SELECT x.*, coalesce(ox.dims, ol.dims) AS od, coalesce(ox.f, ol.f) AS of_, coalesce(tx.dims, tl.dims) AS td, coalesce(tx.f, tl.f) AS tf, coalesce(bx.dims, bl.dims) AS bd, coalesce(bx.f, bl.f) AS bf, z.qu.d AS qd, z.qu.f AS qf, r.dims AS rd, r.f AS rf FROM {name}2 x
   LEFT JOIN u ox ON ox.ex AND ox.a = trim(CASE WHEN p.n2 <> '' THEN p.u2 ELSE p.u1 END) LEFT JOIN u ol ON NOT ol.ex AND ol.a = lower(trim(CASE WHEN p.n2 <> '' THEN p.u2 ELSE p.u1 END))
   LEFT JOIN u tx ON p.n2 <> '' AND tx.ex AND tx.a = trim(p.u1) LEFT JOIN u tl ON p.n2 <> '' AND NOT tl.ex AND tl.a = lower(trim(p.u1))
   LEFT JOIN u bx ON bx.ex AND bx.a = x.b LEFT JOIN u bl ON NOT bl.ex AND bl.a = lower(x.b) LEFT JOIN {name}4 z ON z.id = x.id AND z.doc_id = x.doc_id AND z.name = x.name AND z.tail = x.tail LEFT JOIN r ON r.name = x.name),
 {name} AS (SELECT id, doc_id, scope_key, name, coalesce(od, bd, qd, rd) AS dims,
   CASE WHEN p.n2 <> '' THEN {number("p.n1")} * tf + {number("p.n2")} * of_ ELSE {number("p.n1")} * {SCALE.format("p.sc")} * coalesce(of_, bf, qf, rf) END AS amount FROM {name}5 WHERE p.u1 = '' OR od IS NOT NULL)"""


UNITS = f"""l AS (SELECT unit_group AS g, CASE WHEN factor IS NULL OR isnan(factor) THEN 'unit:' || unit ELSE unit_group END AS dims, alias, case_sensitive AS ex, CASE WHEN factor IS NULL OR isnan(factor) THEN 1.0 ELSE factor END AS f FROM units UNION ALL SELECT * FROM (SELECT g, g AS dims, a AS alias, ex, f FROM (VALUES {EXTRA}) v(g, base, a, ex, f))),
 u AS (SELECT a, ex, min(dims) AS dims, min(f) AS f FROM (SELECT CASE WHEN ex THEN alias ELSE lower(alias) END AS a, ex, dims, f FROM l) GROUP BY 1, 2),
 r AS (SELECT name, min(dims) AS dims, min(f) AS f FROM (SELECT name, trim(unit) AS t FROM rule_inputs) x JOIN u ON u.a = CASE WHEN u.ex THEN x.t ELSE lower(x.t) END GROUP BY 1)"""
VALUES = side("va", "value_id", "gia_tri_nguyen_van", "regexp_extract(tieu_de_cot, '[(]([^()]*)[)][^()]*$', 1)", "cau_chua", "gia_tri_so")
IMAGES = side("im", "number_id", "gia_tri_raw", "don_vi", "trich_dan", "so_lieu_anh")
P1_FOUND = f"""
WITH {UNITS}, {VALUES}, {IMAGES}
SELECT DISTINCT va.id AS value_id, im.id AS number_id FROM va JOIN im USING (doc_id, scope_key, name, dims) WHERE abs(va.amount - im.amount) > 0.01 * greatest(abs(va.amount), abs(im.amount))"""
_ALL = "a AS (SELECT DISTINCT number_id, name FROM so_lieu_anh), x AS (SELECT a.number_id, a.name, im.dims, im.amount, im.id IS NOT NULL AS single FROM a LEFT JOIN im ON im.id = a.number_id AND im.name IS NOT DISTINCT FROM a.name)"
GATE = f"""
WITH {UNITS}, {IMAGES}, {_ALL}
SELECT DISTINCT x.number_id, CASE WHEN NOT single OR (x.dims IS NOT NULL AND x.amount IS NULL) THEN 'no value' WHEN x.dims IS NULL THEN 'no unit' WHEN r.dims IS NULL THEN 'rule without unit' WHEN x.dims <> r.dims THEN 'other kind' WHEN abs(x.amount / r.f) > 1e6 THEN 'out of range' ELSE 'ok' END AS outcome
FROM x LEFT JOIN r ON r.name = x.name"""
CONVERTED = f"""
WITH {UNITS}, {IMAGES}, {_ALL}, b AS (SELECT unit_group AS dims, min(base_unit) AS base FROM units WHERE factor IS NOT NULL AND NOT isnan(factor) GROUP BY 1)
SELECT DISTINCT number_id, CASE WHEN NOT single THEN NULL WHEN abs(amount) >= 1e9 THEN round(amount) ELSE round(amount, 3) END AS amount, CASE WHEN amount IS NULL THEN NULL WHEN starts_with(x.dims, 'unit:') THEN x.dims[6:] ELSE b.base END AS base,
 CASE WHEN NOT single OR (x.dims IS NOT NULL AND amount IS NULL) THEN 'no value' WHEN x.dims IS NULL THEN 'no unit' WHEN starts_with(x.dims, 'unit:') THEN 'not convertible' ELSE 'converted' END AS state, coalesce(b.base IS NOT NULL AND amount BETWEEN 1 AND 1e15, false) AS in_range
FROM x LEFT JOIN b ON b.dims = x.dims"""
