"""Format-preserving pseudonyms of personal numbers and dates, in Spark SQL expressions alone.

A value is validated, read as a whole number below the count of all valid
values of its format, permuted by a keyed Feistel network over exactly that
range and written in the same format. Equal values so get equal pseudonyms in
all documents, different values different ones, and a pseudonym is as valid as
what it stands for. Nothing is joined or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: Characters of an account number, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST",
    26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_LONG_IBAN = "|".join(f"(?:{c})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())

#: Formats, in the order in which they are tried at a place; Java patterns.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\p{L}\p{N}])",
    # Capitals behind an account number do not belong to it: its country's length comes first.
    "iban": r"(?<![\p{L}\p{N}])(?:" + _LONG_IBAN + r")(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    # A time may follow the date of a timestamp.
    "date": r"(?<![\p{L}\p{N}./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?=[Tt][0-9])|(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\p{L}\p{N}/-]|\.[0-9]))",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "ip": r"(?<![\p{L}\p{N}.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{L}\p{N}]|\.[0-9])",
    "nanp": r"(?<![\p{L}\p{N}])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}])\+[1-9](?:[ .()/-]{0,2}[0-9]){7,14}(?![\p{L}\p{N}])",
    # A whole run of groups of digits; the numbers are looked for inside.
    "card": r"(?<![\p{L}\p{N}])(?=(?:[0-9][ -]?){13})[0-9]++(?![\p{L}\p{N}])(?:[ -][0-9]++(?![\p{L}\p{N}]))*+",
}
#: What may stand inside such a run besides.
IN_RUN = ("date", "ssn", "nanp")
#: Layouts of a card number inside a run, the usual ones first; only the last group may have less than three digits.
CARD_LAYOUTS = (
    "[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}",
    "[0-9]{13,19}",
    "[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}",
    *(f"[0-9]{{3,}}(?:[ -][0-9]{{3,}}){{{n}}}[ -][0-9]+" for n in range(5, -1, -1)),
)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(value: str, left: str, right: str, tweak: str, key: str) -> str:
    """The permuted place of ``value`` among ``left * right`` values; both sizes are bigints.

    All three are named once, as the expression is large enough to plan as it is.
    """
    mixed = f"CAST(conv(substr(sha2(concat_ws('|', {_quoted(key)}, {tweak}, CAST(r AS STRING), CAST(s.b AS STRING)), 256), 1, 15), 16, 10) AS BIGINT)"
    start = "named_struct('a', CAST(f.v DIV f.r AS BIGINT), 'b', CAST(f.v % f.r AS BIGINT))"
    step = f"named_struct('a', s.b, 'b', CAST(pmod(s.a + {mixed}, IF(r % 2 = 0, f.l, f.r)) AS BIGINT))"
    moved = f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, r) -> {step}, s -> s.a * f.r + s.b)"
    return _let("f", f"named_struct('v', {value}, 'l', {left}, 'r', {right})", moved)


def _digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def _power(base: int, exponent: str) -> str:
    # Whole numbers; pow() would go through doubles.
    if base == 10:
        return f"CAST(rpad('1', CAST({exponent} AS INT) + 1, '0') AS BIGINT)"
    values = ", ".join(f"{base**i}L" for i in range(0, 14))
    return f"element_at(array({values}), CAST({exponent} AS INT) + 1)"


def _permute_digits(text: str, tweak: str, key: str) -> str:
    """A string of digits as another of the same length; long ones 16 digits at a time."""
    part = f"substr({text}, k * 16 + 1, 16)"
    size = f"length({part})"
    left, right = _power(10, f"({size} + 1) DIV 2"), _power(10, f"{size} DIV 2")
    value = _feistel(f"CAST({part} AS BIGINT)", left, right, f"concat({tweak}, CAST(k AS STRING), '/', CAST({size} AS STRING))", key)
    chunks = f"transform(sequence(0, (length({text}) - 1) DIV 16), k -> lpad(CAST({value} AS STRING), {size}, '0'))"
    return f"IF(length({text}) = 0, '', array_join({chunks}, ''))"


def _permute_letters(text: str, tweak: str, key: str) -> str:
    """A string of a-z as another of the same length, 12 letters at a time."""
    part = f"substr({text}, k * 12 + 1, 12)"
    size = f"length({part})"
    number = f"aggregate(sequence(1, {size}), 0L, (t, i) -> t * 26 + ascii(substr({part}, i, 1)) - 97)"
    left, right = _power(26, f"({size} + 1) DIV 2"), _power(26, f"{size} DIV 2")
    value = _feistel(number, left, right, f"concat({tweak}, CAST(k AS STRING), '/', CAST({size} AS STRING))", key)
    letters = f"array_join(transform(transform(array({value}), v -> transform(sequence(1, {size}), i -> char(97 + CAST((v DIV {_power(26, f'{size} - i')}) % 26 AS INT))))[0], c -> c), '')"
    return f"IF(length({text}) = 0, '', array_join(transform(sequence(0, (length({text}) - 1) DIV 12), k -> {letters}), ''))"


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced by those of ``digits``, in order."""
    done = f"length({_digits(f'substr({shape}, 1, i)')})"
    return f"array_join(transform(sequence(1, length({shape})), i -> IF(substr({shape}, i, 1) RLIKE '[0-9]', substr({digits}, {done}, 1), substr({shape}, i, 1))), '')"


def _luhn_sum(digits: str) -> str:
    """Luhn sum of a string whose last digit counts once."""
    digit = f"CAST(substr({digits}, length({digits}) - i, 1) AS INT)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (t, i) -> t + IF(i % 2 = 0, {digit}, {digit} * 2 - IF({digit} > 4, 9, 0)))"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is so computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _card(m: str, key: str) -> str:
    body = f"concat(substr(d, 1, 1), {_permute_digits('substr(d, 2, length(d) - 2)', _quoted('card'), key)})"
    whole = _let("b", body, f"concat(b, CAST((10 - {_luhn_sum(chr(39).join(['concat(b, ', '0', ')']))} % 10) % 10 AS STRING))")
    return _let("d", _digits(m), _let("n", whole, _refill(m, "n")))


def _is_card(digits: str) -> str:
    return f"(length({digits}) BETWEEN 13 AND 19 AND {digits} NOT RLIKE '^([0-9])\\\\1*$' AND {_luhn_sum(digits)} % 10 = 0)"


#: Kinds of pieces: text that stays, a value of another format, a card number.
STAYS, VALUE, NUMBER = 0, 1, 2


def _piece(kind: int, text: str) -> str:
    return f"named_struct('k', {kind}, 't', {text})"


def _pieces(m: str) -> str:
    """A value as one piece; a run of digits cut at the card numbers between borders of its groups, and at values of other formats in the rest.

    What is cut here is replaced elsewhere, so each format's expression stands in the plan once.
    """
    # The whole run comes before any other reading.
    whole = f"array(named_struct('k', -1, 'p', 1, 'c', {m}))"
    readings = ", ".join(f"named_struct('k', {k}, 'p', p, 'c', regexp_extract(w, {_quoted('^(?:' + x + ')(?![0-9])')}, 0))" for k, x in enumerate(CARD_LAYOUTS))
    starts = f"filter(sequence(1, length({m})), p -> p = 1 OR substr({m}, p - 1, 1) IN (' ', '-'))"
    every = f"concat({whole}, flatten(transform({starts}, p -> {_let('w', f'substr({m}, p, 40)', f'array({readings})')})))"
    valid = f"array_sort(filter({every}, x -> {_let('d', _digits('x.c'), _is_card('d'))}))"
    clear = "exists(s, y -> x.p < y.p + length(y.c) AND y.p < x.p + length(x.c))"
    chosen = f"aggregate(v, filter(v, x -> false), (s, x) -> IF({clear}, s, concat(s, array(x))))"
    ordered = f"concat(array_sort(transform({_let('v', valid, chosen)}, x -> named_struct('p', x.p, 'c', x.c))), array(named_struct('p', length({m}) + 1, 'c', '')))"
    pattern = _quoted("|".join(f"(?:{PATTERNS[name]})" for name in IN_RUN))
    rest = f"flatten(zip_with(split(z, {pattern}, -1), regexp_extract_all(z, {pattern}, 0), (x, y) -> array({_piece(STAYS, 'x')}, {_piece(VALUE, "coalesce(y, '')")})))"
    rest = _let("z", f"substr({m}, s.at, x.p - s.at)", rest)
    start = "named_struct('o', CAST(array() AS ARRAY<STRUCT<k: INT, t: STRING>>), 'at', 1)"
    parts = f"aggregate({ordered}, {start}, (s, x) -> named_struct('o', concat(s.o, {rest}, array({_piece(NUMBER, 'x.c')})), 'at', x.p + length(x.c)), s -> s.o)"
    return f"IF({m} RLIKE {_quoted('^(?:' + PATTERNS['card'] + ')$')}, {parts}, array({_piece(VALUE, m)}))"


def _ssn(m: str, key: str) -> str:
    area, group, serial = (f"CAST(substr({m}, {i}, {n}) AS BIGINT)" for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = f"{area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0"
    number = f"(({area} - IF({area} > 666, 2, 1)) * 99 + {group} - 1) * 9999 + {serial} - 1"
    moved = _feistel(number, "88902L", "9999L", _quoted("ssn"), key)
    text = "concat_ws('-', lpad(CAST(v DIV 989901 + IF(v DIV 989901 >= 665, 2, 1) AS STRING), 3, '0'), lpad(CAST((v DIV 9999) % 99 + 1 AS STRING), 2, '0'), lpad(CAST(v % 9999 + 1 AS STRING), 4, '0'))"
    return f"IF({valid}, {_let('v', moved, text)}, {m})"


def _ip(m: str, key: str) -> str:
    number = f"aggregate(split({m}, '[.]'), 0L, (t, x) -> t * 256 + CAST(x AS BIGINT))"
    moved = _feistel(number, "65536L", "65536L", _quoted("ip"), key)
    text = "concat_ws('.', v DIV 16777216, (v DIV 65536) % 256, (v DIV 256) % 256, v % 256)"
    return f"IF(forall(split({m}, '[.]'), x -> CAST(x AS INT) < 256), {_let('v', moved, text)}, {m})"


def _nanp(m: str, key: str) -> str:
    """Area and exchange run from 200 to 999, the line from 0 to 9999."""
    number = "((CAST(substr(d, -10, 3) AS BIGINT) - 200) * 800 + CAST(substr(d, -7, 3) AS BIGINT) - 200) * 10000 + CAST(substr(d, -4, 4) AS BIGINT)"
    moved = _feistel(number, "80000L", "80000L", _quoted("nanp"), key)
    text = "concat(substr(d, 1, length(d) - 10), CAST(v DIV 8000000 + 200 AS STRING), CAST((v DIV 10000) % 800 + 200 AS STRING), lpad(CAST(v % 10000 AS STRING), 4, '0'))"
    return _let("d", _digits(m), _let("n", _let("v", moved, text), _refill(m, "n")))


def _phone(m: str, key: str) -> str:
    whole = f"concat(substr(d, 1, 3), {_permute_digits('substr(d, 4)', 'concat(' + _quoted('phone') + ', substr(d, 1, 3))', key)})"
    return _let("d", _digits(m), _let("n", whole, _refill(m, "n")))


def _date(m: str, key: str) -> str:
    """Days from 1900-01-01 on, 73,000 of them; other dates stay. Month first, if that is a date.

    Days and months of one digit are written without zeros, so any day fits the layout.
    """
    iso = f"substr({m}, 5, 1) = '-'"
    us, eu, dotted = (f"try_to_timestamp({m}, '{x}')" for x in ("M/d/yyyy", "d/M/yyyy", "d.M.yyyy"))
    full = f"length({m}) = 10"
    layout = (
        f"CASE WHEN {iso} THEN IF({full}, 'yyyy-MM-dd', 'yyyy-M-d') WHEN {us} IS NOT NULL THEN IF({full}, 'MM/dd/yyyy', 'M/d/yyyy')"
        f" WHEN {eu} IS NOT NULL THEN IF({full}, 'dd/MM/yyyy', 'd/M/yyyy') WHEN {dotted} IS NOT NULL THEN IF({full}, 'dd.MM.yyyy', 'd.M.yyyy') END"
    )
    day = "datediff(CAST(try_to_timestamp(%s, l) AS DATE), DATE '1900-01-01')" % m
    moved = _feistel("CAST(n AS BIGINT)", "250L", "292L", _quoted("date"), key)
    text = f"date_format(date_add(DATE '1900-01-01', CAST({moved} AS INT)), l)"
    return _let("l", layout, f"{_let('n', day, f'IF(n >= 0 AND n < 73000, {text}, {m})')}")


def _iban_rest(text: str) -> str:
    """Remainder by 97 of letters and digits read as the standard does."""
    code = f"ascii(substr({text}, i, 1))"
    return f"aggregate(sequence(1, length({text})), 0L, (t, i) -> IF({code} < 58, (t * 10 + {code} - 48) % 97, (t * 100 + {code} - 55) % 97))"


def _iban(m: str, key: str) -> str:
    """The digits behind the country and check digits move; the check digits follow."""
    account = f"{_refill('substr(c, 5)', 'p')}"
    moved = _permute_digits(_digits("substr(c, 5)"), "concat(" + _quoted("iban") + ", substr(c, 1, 2))", key)
    digits = f"concat(lpad(CAST(98 - {_iban_rest(chr(39).join(['concat(a, substr(c, 1, 2), ', '00', ')']))} AS STRING), 2, '0'), p)"
    filled = _let("p", moved, _let("a", account, _let("q", digits, _refill(m, "q"))))
    return _let("c", f"replace({m}, ' ', '')", f"IF({_iban_rest('concat(substr(c, 5), substr(c, 1, 4))')} = 1, {filled}, {m})")


def _email(m: str, key: str) -> str:
    """Letters and digits before the @ move, each kind among itself; capitals stay where they are."""
    letters = _permute_letters("g", "concat(" + _quoted("mail") + ", n)", key)
    digits = _permute_digits("h", "concat(" + _quoted("maildigits") + ", CAST(length(u) AS STRING))", key)
    at = "substr(u, i, 1)"
    letter = "substr(w, length(regexp_replace(substr(u, 1, i), '[^A-Za-z]', '')), 1)"
    digit = f"substr(n, length({_digits('substr(u, 1, i)')}), 1)"
    rebuilt = f"array_join(transform(sequence(1, length(u)), i -> CASE WHEN {at} RLIKE '[a-z]' THEN {letter} WHEN {at} RLIKE '[A-Z]' THEN upper({letter}) WHEN {at} RLIKE '[0-9]' THEN {digit} ELSE {at} END), '')"
    local = _let("h", _digits("u"), _let("n", digits, _let("g", "regexp_replace(lower(u), '[^a-z]', '')", _let("w", letters, rebuilt))))
    return _let("u", f"substring_index({m}, '@', 1)", f"concat({local}, '@', substring_index({m}, '@', -1))")


def pseudonym(match: str, key: str) -> str:
    """SQL for the pseudonym of the SQL string ``match``; what fails its format's check stays as it is."""
    makers = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "nanp": _nanp, "phone": _phone}
    whole = lambda name: _quoted("^(?:" + PATTERNS[name] + ")$")
    cases = " ".join(f"WHEN j.t RLIKE {whole(name)} THEN {maker('j.t', key)}" for name, maker in makers.items())
    moved = f"CASE WHEN j.k = {STAYS} OR j.t = '' THEN j.t WHEN j.k = {NUMBER} THEN {_card('j.t', key)} {cases} ELSE j.t END"
    return f"array_join(transform({_pieces(match)}, j -> {moved}), '')"


def _replaced(text: str, key: str) -> str:
    """SQL for the string ``text`` with every value of a known format replaced."""
    moved = f"transform(regexp_extract_all({text}, {_quoted(ANY)}, 0), m -> {pseudonym('m', key)})"
    return f"array_join(flatten(zip_with(split({text}, {_quoted(ANY)}, -1), {moved}, (x, y) -> array(x, coalesce(y, '')))), '')"


def pseudonymised(text: str, key: str) -> Column:
    """The string column ``text`` with every value of a known format replaced."""
    joined = _replaced(f"`{text}`", key)
    # Texts without a digit or an at sign, the most, are not searched.
    return F.expr(f"CASE WHEN `{text}` RLIKE '[0-9@]' AND `{text}` RLIKE {_quoted(ANY)} THEN {joined} ELSE `{text}` END")


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with personal values in the column ``text`` replaced; all other columns and rows stay.

    Card numbers are checked by Luhn, also between other groups of digits, account numbers by their remainder,
    social security numbers by their reserved areas, addresses by their bytes,
    dates by the calendar (1900 on, 73,000 days). A null text stays null, an
    empty one empty; repeated values get one pseudonym everywhere. ``key`` is
    a secret of the caller; with another key there are other pseudonyms.
    """
    return docs.withColumn(text, pseudonymised(text, key))
