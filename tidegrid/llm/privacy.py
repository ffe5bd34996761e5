"""Format-preserving pseudonyms for personal data, in DataFrame and SQL functions only.

A value found and validated becomes a list of symbols, each with its own radix: digits, letters of either
case, hexadecimal digits, address bytes, parts of a number or of a date. A keyed Feistel network permutes the lists of
these radices: the symbols of one half are shifted, each modulo its radix, by a keyed hash of the
other half, in turns. The result has the format of the value, equal values get equal pseudonyms in every
document, and the key undoes it. Check digits are computed anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, table

ROUNDS = 8
#: Days from 1850-01-01 that dates are permuted among: 300 x 365, until 2149-10-15.
DAY_ZERO, DAY_PARTS = "1850-01-01", (300, 365)

#: Symbols of a secret that are permuted together.
PIECE = 128
#: The session's setting with the key.
SETTING = "spark.tidegrid.pseudonyms.key"

#: What counts as personal data: kind and pattern, earlier ones first. Secrets may have any length, the others are bounded.
_NAMED = r"(?i:password|passwd|token|secret|api_key)\s{0,2}[=:]\s{0,2}"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "secret": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "hex": rf"""(?<=[=:"' ])(?<={_NAMED}["']?)[0-9a-fA-F]{{12,}}+(?![0-9A-Za-z])""",
    "phone": r"(?<![\w+])(?:\+\d{1,3} ?)?\(\d{3}\) \d{3}-\d{4}(?!\d)|(?<![\w-])\+\d{1,3}[ -]\d{3}[ -]\d{3}[ -]\d{4}(?!\d)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\d-])|(?<![\w+-])(?<!\d )0\d{2,4} \d{3} \d{4}(?![\w-]| \d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w/-]|\.\d)",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
}
#: Numbers joined by hyphens, unless another value begins here. Cards are looked for in a whole run of these, joined by spaces.
_NO_OTHER = "(?!" + "|".join(f"(?:{PATTERNS[k]})" for k in ("email", "phone", "ssn", "date", "ip")) + ")"
_ONE, _JOINED = (_NO_OTHER + rf"\d++(?:-\d++){n}(?![\w-])" for n in ("*+", "++"))
PATTERNS["card"] = rf"(?<![\w-])(?:(?=\d(?:[ -]?\d){{12}})(?:{_JOINED}(?: {_ONE})*+|{_ONE}(?: {_ONE})++)|\d{{13,19}}(?![\w-]))"
#: In quotes after the name of a secret: 8 characters or more without white space, with a letter and a digit.
PATTERNS["quoted"] = rf"""(?<=["'])(?<={_NAMED}["'])(?=[^\s"'0-9]*+[0-9])(?=[^\s"'A-Za-z]*+[A-Za-z])[^\s"']{{8,}}+(?=["'])"""
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _text(value: str) -> str:
    """A SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, rest: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {rest}), 1)"


def _feistel(symbols: str, radices: str, key: str, kind: str) -> str:
    """Permute the lists of symbols below the radices."""
    half = f"CAST(size({radices}) div 2 AS INT)"
    shift = f"CAST(conv(substr(sha2(concat_ws('|', {_text(key)}, {kind}, r, i, array_join(%s, ',')), 256), 1, 12), 16, 10) AS BIGINT)"
    moved = lambda own, other, rad: f"transform({own}, (x, i) -> pmod(x + {shift % other}, get({rad}, i)))"
    parts = f"slice({radices}, 1, {half})", f"slice({radices}, {half} + 1, size({radices}))"
    step = f"""(s, r) -> named_struct('a', CASE WHEN r % 2 = 0 THEN {moved('s.a', 's.b', parts[0])} ELSE s.a END,
                                      'b', CASE WHEN r % 2 = 1 THEN {moved('s.b', 's.a', parts[1])} ELSE s.b END)"""
    first = f"named_struct('a', slice({symbols}, 1, {half}), 'b', slice({symbols}, {half} + 1, size({symbols})))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {first}, {step}, s -> concat(s.a, s.b))"


def _longs(items: str) -> str:
    return f"transform({items}, x -> CAST(x AS BIGINT))"


def _sets(*classes: str) -> str:
    return "array(" + ", ".join(map(_text, classes)) + ")"


def _characters(value: str, sets: str, key: str, kind: str) -> str:
    """Permute the characters of `value` that are in one of the classes `sets`, each within its class."""
    chars = f"filter(split({value}, ''), c -> c <> '')"
    cls = f"transform(_ch, c -> coalesce(get(filter({sets}, s -> instr(s, c) > 0), 0), ''))"
    own = "filter(_ch, (c, i) -> get(_cl, i) <> '')"
    syms = f"transform({own}, c -> CAST(instr(get(filter({sets}, s -> instr(s, c) > 0), 0), c) - 1 AS BIGINT))"
    rads = "transform(filter(_cl, s -> s <> ''), s -> CAST(length(s) AS BIGINT))"
    rank = "size(filter(slice(_cl, 1, i + 1), s -> s <> ''))"
    back = f"array_join(transform(_ch, (c, i) -> CASE WHEN get(_cl, i) = '' THEN c ELSE substr(get(_cl, i), CAST(get(_pm, {rank} - 1) AS INT) + 1, 1) END), '')"
    return _let("_ch", chars, _let("_cl", cls, _let("_pm", _feistel(syms, rads, key, kind), back)))


def _luhn(digits: str) -> str:
    """Sum of a list of digits by Luhn's rule, the last one as the check digit."""
    return f"aggregate(transform(reverse({digits}), (d, i) -> CASE WHEN i % 2 = 0 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END), 0L, (s, d) -> s + d)"


def pseudonym(key: str) -> str:
    """SQL of m, a found value: a struct of v, its pseudonym or m itself if it isn't valid, and n, the values replaced."""
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    is_ = lambda kind: f"m RLIKE {_text('^(?:' + SHAPES[kind] + ')$')}"
    numbers = "transform(filter(split(m, ''), c -> c RLIKE '[0-9]'), c -> CAST(c AS BIGINT))"
    # the digits put back to where digits were
    into = lambda new: f"array_join(transform(filter(split(m, ''), c -> c <> ''), (c, i) -> CASE WHEN c RLIKE '[0-9]' THEN CAST(get({new}, length(regexp_replace(substr(m, 1, i + 1), '[^0-9]', '')) - 1) AS STRING) ELSE c END), '')"
    tens = lambda n: f"array_repeat(10L, {n})"
    listed = lambda d: f"transform(filter(split({d}, ''), x -> x <> ''), x -> CAST(x AS BIGINT))"
    new = _let(
        "_d", listed("c.d"),
        _let("_p", f"concat(slice(_d, 1, 1), {_feistel('slice(_d, 2, size(_d) - 2)', tens('size(_d) - 2'), key, _text('card'))})",
             f"array_join(transform(concat(_p, array(pmod(10 - {_luhn('concat(_p, array(0L))')} % 10, 10L))), x -> CAST(x AS STRING)), '')"),
    )
    # parts of the run that hold: the whole first, then those grouped as on cards, then others
    rank = f"CASE WHEN w = size(_g) THEN 0 WHEN array_join(slice(_g, i + 1, w), ' ') RLIKE {_text(CARD_GROUPS)} THEN 2 ELSE 4 END + CASE WHEN x RLIKE '^[2-6]' THEN 0 ELSE 1 END"
    part = f"named_struct('r', {rank}, 'i', i, 'v', -w, 'w', w, 'd', array_join(slice(_g, i + 1, w), ''))"
    parts = f"flatten(transform(_g, (x, i) -> filter(transform(sequence(1, least(19, size(_g) - i)), w -> {part}), c -> length(c.d) BETWEEN 13 AND 19 AND {_luhn(listed('c.d'))} % 10 = 0)))"
    chosen = "aggregate(array_sort(_w), filter(_w, c -> false), (s, c) -> CASE WHEN exists(s, o -> o.i < c.i + c.w AND c.i < o.i + o.w) THEN s ELSE concat(s, array(c)) END)"
    own = "get(filter(_n, c -> k >= c.i AND k < c.i + c.w), 0)"
    group = _let("_o", own, "CASE WHEN _o IS NULL THEN x ELSE substr(_o.t, 1 + length(array_join(slice(_g, _o.i + 1, k - _o.i), '')), length(x)) END")
    cards = _let(
        "_g", "split(m, '[ -]')",
        _let("_w", parts,
             _let("_n", f"transform({chosen}, c -> named_struct('i', c.i, 'w', c.w, 'd', c.d, 't', {new}))",
                  _let("_s", "regexp_extract_all(m, '[ -]', 0)",
                       f"named_struct('v', CASE WHEN size(_n) = 0 THEN m ELSE array_join(transform(_g, (x, k) -> concat({group}, coalesce(get(_s, k), ''))), '') END, 'n', size(filter(_n, c -> c.t <> c.d)))"))),
    )
    ip = _let("_o", _longs("split(m, '[.]')"), f"CASE WHEN exists(_o, x -> x > 255) THEN m ELSE array_join({_feistel('_o', 'array_repeat(256L, 4)', key, _text('ip'))}, '.') END")
    ssn = _let(
        "_o", _longs("split(m, '-')"),
        "CASE WHEN get(_o, 0) IN (0, 666) OR get(_o, 0) > 899 OR get(_o, 1) = 0 OR get(_o, 2) = 0 THEN m ELSE "
        + _let("_n", _feistel("array(get(_o, 0) - CASE WHEN get(_o, 0) > 666 THEN 2 ELSE 1 END, get(_o, 1) - 1, get(_o, 2) - 1)", "array(898L, 99L, 9999L)", key, _text("ssn")),
               "format_string('%03d-%02d-%04d', get(_n, 0) + CASE WHEN get(_n, 0) > 664 THEN 2 ELSE 1 END, get(_n, 1) + 1, get(_n, 2) + 1)") + " END",
    )
    a, b = DAY_PARTS
    form = "CASE WHEN instr(m, '-') > 0 THEN 'yyyy-MM-dd' WHEN instr(m, '.') > 0 THEN 'dd.MM.yyyy' WHEN m LIKE '____/%' THEN 'yyyy/MM/dd' ELSE 'MM/dd/yyyy' END"
    day = f"datediff(CAST(try_to_timestamp(m, {form}) AS DATE), DATE'{DAY_ZERO}')"
    date = _let(
        "_n", f"CAST({day} AS BIGINT)",
        f"CASE WHEN _n IS NULL OR _n < 0 OR _n >= {a * b} THEN m ELSE "
        + _let("_p", _feistel(f"array(_n div {b}, _n % {b})", f"array({a}L, {b}L)", key, _text("date")),
               f"date_format(date_add(DATE'{DAY_ZERO}', CAST(get(_p, 0) * {b} + get(_p, 1) AS INT)), {form})") + " END",
    )
    phone = _let("_d", numbers, _let("_c", "CASE WHEN m LIKE '+%' OR m LIKE '0%' THEN size(_d) - 10 ELSE 0 END", _let("_q", f"concat(slice(_d, 1, _c), {_feistel('slice(_d, _c + 1, 10)', tens('10'), key, _text('phone'))})", into("_q"))))
    email = f"concat({_characters("substring_index(m, '@', 1)", _sets(digits, lower, upper), key, _text('email'))}, '@', substring_index(m, '@', -1))"
    secret = f"concat('AKIA', {_characters('substr(m, 5)', _sets(digits, upper), key, _text('secret'))})"
    # hexadecimal in one case throughout or in both, or any characters; copies in upper case get the pseudonym in upper case
    hexa, both = "m RLIKE '^[0-9a-fA-F]{12,}$'", "m RLIKE '[a-f]' AND m RLIKE '[A-F]'"
    about = f"""CASE WHEN NOT {hexa} THEN named_struct('k', 'quoted', 'v', m, 's', {_sets(digits, lower, upper)})
      WHEN {both} THEN named_struct('k', 'mixed', 'v', m, 's', {_sets(digits, 'abcdef', 'ABCDEF')}) ELSE named_struct('k', 'hex', 'v', lower(m), 's', {_sets(digits + 'abcdef')}) END"""
    piece = _characters(f"substr(_a.v, {PIECE} * _i + 1, {PIECE})", "_a.s", key, "concat(_a.k, CASE WHEN _i > 0 THEN concat(':', _i) ELSE '' END)")
    joined = f"array_join(transform(sequence(0, (length(m) - 1) div {PIECE}), _i -> {piece}), '')"
    keyword = _let("_a", about, _let("_x", joined, "CASE WHEN _a.k = 'hex' AND m RLIKE '[A-F]' THEN upper(_x) ELSE _x END"))
    other = f"""CASE WHEN {is_('email')} THEN {email} WHEN {is_('secret')} THEN {secret} WHEN {is_('ip')} THEN {ip} WHEN {is_('ssn')} THEN {ssn}
      WHEN {is_('date')} THEN {date} WHEN {is_('phone')} THEN {phone} ELSE {keyword} END"""
    return f"CASE WHEN {is_('card')} THEN {cards} ELSE {_let('_v', other, "named_struct('v', _v, 'n', CAST(m <> _v AS INT))")} END"


#: Whole values by kind, once found.
SHAPES = {
    "email": "[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@([A-Za-z0-9-]{1,63}[.]){1,8}[A-Za-z]{2,24}",
    "secret": "AKIA[A-Z0-9]{16}",
    "ip": r"[0-9]{1,3}([.][0-9]{1,3}){3}",
    "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "date": "[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[.][0-9]{2}[.][0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}",
    "phone": r"([+][0-9]{1,3} ?)?[(][0-9]{3}[)] [0-9]{3}-[0-9]{4}|[+][0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3}[ -][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|0[0-9]{2,4} [0-9]{3} [0-9]{4}",
    "card": "[0-9]{13,19}|(?![0-9]{3}-[0-9]{3}-[0-9]{4}$|0[0-9]{2,4} [0-9]{3} [0-9]{4}$|[0-9]{3}-[0-9]{2}-[0-9]{4}$|[0-9]{4}-[0-9]{2}-[0-9]{2}$)[0-9]+([ -][0-9]+)+",
}
#: How the digits of cards are grouped.
CARD_GROUPS = "^([0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}( [0-9]{3})?|[0-9]{4} [0-9]{6} [0-9]{4,5}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9])$"


def pseudonymised(docs: DataFrame, key: str | None = None) -> DataFrame:
    """`docs` with pseudonyms in text, and n_private (long), the values replaced.

    `key` undoes the pseudonyms, so keep it apart from the data; by default it is the session's SETTING, and an error without.

    Found are: addresses of mail and of hosts (a.b.c.d); cards; social security numbers; dates as 1999-12-31, 1999/12/31, 31.12.1999 or
    12/31/1999; phone numbers as (555) 555-0147, 555-555-0147, with +1 and spaces or hyphens, or 0171 555 0147; access keys AKIA...; and
    after password, passwd, token, secret or api_key and = or :, 12 hexadecimal digits or more, or a quoted string of 8 characters or
    more with a letter and a digit. Secrets of over PIECE characters are permuted in pieces of that size. A card is a run of 13 to 19 digits, or a part of a run cut at spaces or hyphens; of parts that overlap, one grouped as
    cards are comes first. Numbers that fail their check (Luhn's for cards, byte ranges for addresses, assigned parts for social
    security numbers, the calendar for dates, 1850-01-01 to 2149-10-15) stay as they are. A card keeps its first digit, a phone number
    its country code, an address of mail its domain. Null text stays null with 0. One row per row, in place: repeats get equal
    results. Other columns pass through; a column named n_private is replaced.
    """
    key = key or docs.sparkSession.conf.get(SETTING, None)
    if not key:
        raise ValueError(f"give a key, or set {SETTING}")
    docs, back = aside(docs.drop("n_private"), "text")
    found, parts = F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), F.split("text", ANY, -1)
    may = F.col("text").rlike("[0-9@]")
    rows = docs.withColumn("_m", F.when(may, found)).withColumn("_p", F.when(F.size("_m") > 0, parts))
    rows = rows.withColumn("_n", F.expr(f"transform(_m, m -> {pseudonym(key)})"))
    text = F.expr("CASE WHEN size(_p) > 1 THEN array_join(transform(_p, (p, i) -> concat(p, coalesce(get(_n, i).v, ''))), '') ELSE text END")
    changed = F.coalesce(F.expr("aggregate(_n, 0L, (s, x) -> s + x.n)"), F.lit(0).cast("long"))
    return rows.select(*(text.alias("text") if c == "text" else own for c, own in back.items()), F.greatest(changed, F.lit(0)).alias("n_private"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the session's key; the made-up documents do with one known to all."""
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(SETTING, "tidegrid"))
