"""Format-preserving pseudonyms for personal data, with SQL functions only.

Numbers and dates are found by one pattern, validated, and permuted within their format by a keyed alternating Feistel
network over a product of two ranges: (a, b) in na x nb, where each round adds a keyed hash of one half to the other, modulo
its range. It permutes any such product, so no value leaves its format and equal values get equal pseudonyms in all
documents. Addresses and secrets have no numeric range; the same network adds to their letters and digits one by one, each
within its kind. Values that fail validation stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
SECRET_WORDS = "password|passwd|pwd|secret|token|api_key|apikey|access_key"
# from the first letter (of any script) or digit of a run, of any length; the domain stays
EMAIL = r"(?<![\p{L}0-9][._%+\-]{1,8})[\p{L}0-9][\p{L}0-9._%+\-]*+@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)+"
KEY_ID = r"AKIA[A-Z0-9]{16}"
# after a keyword, in quotes or not, a mark and up to 16 blanks each, or after an authorization header's scheme
BEFORE_SECRET = rf"(?i:{SECRET_WORDS})[\"']?[ \t]{{0,16}}(?:=>|:=|=|:)[ \t]{{0,16}}[\"']?|(?i:authorization)[\"']?[ \t]{{0,16}}[=:][ \t]{{0,16}}[\"']?(?i:bearer|basic|token)[ \t]{{1,16}}"
# a run of any length, never given back; dots join its parts
SECRET = rf"(?<={BEFORE_SECRET})[A-Za-z0-9_/+\-](?:[A-Za-z0-9_/+\-!@#$%^*~]|\.(?=[A-Za-z0-9_/+\-])){{7,}}+"
IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
# after +1 or in brackets any number counts; bare groups of digits need an area code and an exchange from 200 up
PHONE = (
    r"(?:\+1[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})|(?:1[ .\-]?)?\([0-9]{3}\))[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}"
    r"|(?:1[ .\-]?)?[2-9][0-9]{2}[ .\-]?[2-9][0-9]{2}[ .\-][0-9]{4}"
)
ABROAD = r"\+[2-9][0-9](?:[ .\-()]{0,2}[0-9]){6,12}"
CARD = r"(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){2}[ \-][0-9]{1,7}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})"
# the longest kinds come first where two could start at one place
ALL = rf"(?<![A-Za-z0-9_])(?:{EMAIL}|{KEY_ID}|{SECRET}|{CARD}|{IPV4}|{DATE}|{SSN}|{PHONE}|{ABROAD})(?![A-Za-z0-9_])"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Pseudonyms:
    """SQL text of the permutations under a key. x stands for SQL text of a string value."""

    def __init__(self, key: str):
        self.key = key

    def prf(self, kind: str, turn: str, value: str) -> str:
        """A keyed 60-bit number."""
        return f"cast(conv(substring(sha2(concat({_quoted(self.key + '|' + kind + '|')}, {turn}, '|', {value}), 256), 1, 15), 16, 10) as bigint)"

    def pair(self, kind: str, a: str, b: str, na: str, nb: str) -> str:
        """SQL struct (a, b): the permuted pair of (a, b) in na x nb."""
        fa, fb = self.prf(kind, "t", "s.b"), self.prf(kind, "t", "s.a")
        one = f"if(t % 2 = 0, named_struct('a', (s.a + {fa}) % ({na}), 'b', s.b), named_struct('a', s.a, 'b', (s.b + {fb}) % ({nb})))"
        return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, t) -> {one})"

    def digits(self, kind: str, d: str) -> str:
        """Permuted digit string of 2 to 36 digits; its length is part of the key."""
        n = f"length({d})"
        u = f"cast({n} div 2 as int)"
        ten = lambda k: f"cast(rpad('1', {k} + 1, '0') as bigint)"
        pair = self.pair(kind, f"substring({d}, 1, {u})", f"substring({d}, {u} + 1)", ten(u), ten(f"({n} - {u})"))
        return f"transform(array({pair}), q -> concat(lpad(cast(q.a as string), {u}, '0'), lpad(cast(q.b as string), {n} - {u}, '0')))[0]"

    @staticmethod
    def luhn_sum(d: str, first_doubled: int) -> str:
        """Luhn sum of a digit string from its right end; first_doubled 1: the last digit is doubled."""
        v = f"cast(substring({d}, length({d}) - i, 1) as int)"
        return f"aggregate(sequence(0, length({d}) - 1), 0, (z, i) -> z + if(i % 2 = {1 - first_doubled}, 2 * {v} - if({v} > 4, 9, 0), {v}))"

    @staticmethod
    def refill(form: str, d: str) -> str:
        """The digits of form replaced in turn by those of d."""
        put = f"if(c rlike '[0-9]', named_struct('o', concat(s.o, substring({d}, s.k + 1, 1)), 'k', s.k + 1), named_struct('o', concat(s.o, c), 'k', s.k))"
        return f"aggregate(split({form}, ''), named_struct('o', '', 'k', 0), (s, c) -> {put}, s -> s.o)"

    def letters(self, kind: str, x: str) -> str:
        """Letters and digits of a string, each within its kind: halves are shifted by keyed hashes of each other, so the
        form stays and different strings stay different. Case and length are the form."""
        half = f"cast((length({x}) + 1) div 2 as int)"

        def shifted(own: str, other: str) -> str:
            # a long half is hashed once, so that the work grows with the length only
            o = f"if(length({other}) > 256, sha2({other}, 256), {other})"
            k = f"({self.prf(kind, 't', "concat(i + 1, '|', w.o)")})"
            moved = lambda base, n: f"chr(cast({base} + (ascii(c) - {base} + {k}) % {n} as int))"
            to = f"case when c rlike '[0-9]' then {moved(48, 10)} when c rlike '[a-z]' then {moved(97, 26)} when c rlike '[A-Z]' then {moved(65, 26)} else c end"
            return f"transform(array(named_struct('w', {own}, 'o', {o})), w -> array_join(transform(split(w.w, ''), (c, i) -> {to}), ''))[0]"

        one = f"if(t % 2 = 0, named_struct('a', {shifted('s.a', 's.b')}, 'b', s.b), named_struct('a', s.a, 'b', {shifted('s.b', 's.a')}))"
        return f"aggregate(sequence(0, 3), named_struct('a', substring({x}, 1, {half}), 'b', substring({x}, {half} + 1)), (s, t) -> {one}, s -> concat(s.a, s.b))"

    def email(self, x: str) -> str:
        return f"concat({self.letters('email', f"substring_index({x}, '@', 1)")}, '@', substring_index({x}, '@', -1))"

    def ipv4(self, x: str) -> str:
        o = lambda i: f"cast(split({x}, '[.]')[{i}] as bigint)"
        pair = self.pair("ipv4", f"{o(0)} * 256 + {o(1)}", f"{o(2)} * 256 + {o(3)}", "65536", "65536")
        return f"transform(array({pair}), q -> concat_ws('.', q.a div 256, q.a % 256, q.b div 256, q.b % 256))[0]"

    def date(self, x: str) -> str:
        # 1700 to 2099: 400 years are 146097 = 189 * 773 days
        day = f"datediff(try_cast({x} as date), date'1700-01-01')"
        pair = self.pair("date", f"{day} div 773", f"{day} % 773", "189", "773")
        return f"transform(array({pair}), q -> cast(date_add(date'1700-01-01', cast(q.a * 773 + q.b as int)) as string))[0]"

    def ssn(self, x: str) -> str:
        area = f"cast(substring({x}, 1, 3) as bigint)"
        a = f"({area} - if({area} > 666, 2, 1))"
        b = f"((cast(substring({x}, 5, 2) as bigint) - 1) * 9999 + cast(substring({x}, 8, 4) as bigint) - 1)"
        pair = self.pair("ssn", a, b, "898", "989901")
        back = "concat_ws('-', lpad(cast(q.a + if(q.a >= 665, 2, 1) as string), 3, '0'), lpad(cast(q.b div 9999 + 1 as string), 2, '0'), lpad(cast(q.b % 9999 + 1 as string), 4, '0'))"
        return f"transform(array({pair}), q -> {back})[0]"

    def phone(self, x: str) -> str:
        """Numbers that a bare form may have are permuted among themselves, in 800 x 8,000,000, and the other 3.6 * 10 ** 9 of ten
        digits among themselves, so a number has one pseudonym in all forms and each form stays valid."""
        d = f"right(regexp_replace({x}, '[^0-9]', ''), 10)"
        area, rest = f"cast(substring({d}, 1, 3) as bigint)", f"cast(substring({d}, 4) as bigint)"
        bare = self.pair("phone", f"{area} - 200", f"{rest} - 2000000", "800", "8000000")
        # areas below 200 come first, then for each other area the exchanges below 200
        n = f"if({area} < 200, {area} * 10000000 + {rest}, 2000000000 + ({area} - 200) * 2000000 + {rest})"
        other = self.pair("phone_other", f"({n}) div 60000", f"({n}) % 60000", "60000", "60000")
        back = "if(m < 2000000000, lpad(cast(m as string), 10, '0'), concat((m - 2000000000) div 2000000 + 200, lpad(cast((m - 2000000000) % 2000000 as string), 7, '0')))"
        new = f"if({area} >= 200 and {rest} >= 2000000, transform(array({bare}), q -> concat(q.a + 200, q.b + 2000000))[0], transform(transform(array({other}), q -> q.a * 60000 + q.b), m -> {back})[0])"
        lead = f"left(regexp_replace({x}, '[^0-9]', ''), length(regexp_replace({x}, '[^0-9]', '')) - 10)"
        return f"transform(array({new}), q -> {self.refill(x, f'concat({lead}, q)')})[0]"

    def abroad(self, x: str) -> str:
        d = f"regexp_replace({x}, '[^0-9]', '')"
        return f"transform(array(concat(left({d}, 2), {self.digits('abroad', f'substring({d}, 3)')})), e -> {self.refill(x, 'e')})[0]"

    def card(self, x: str) -> str:
        body = f"left(regexp_replace({x}, '[^0-9]', ''), length(regexp_replace({x}, '[^0-9]', '')) - 1)"
        check = f"cast((10 - {self.luhn_sum('p', 1)} % 10) % 10 as string)"
        return f"transform(transform(array({self.digits('card', body)}), p -> concat(p, {check})), e -> {self.refill(x, 'e')})[0]"

    def kind(self, x: str) -> str:
        """The kind of a found value if it is valid, else null."""
        d = f"regexp_replace({x}, '[^0-9]', '')"
        is_ = lambda p: f"{x} rlike {_quoted('^(?:' + p + ')$')}"
        octets = f"forall(split({x}, '[.]'), o -> cast(o as int) <= 255 and (o = '0' or o not like '0%'))"
        day = f"try_cast({x} as date) between date'1700-01-01' and date'2099-12-31'"
        ssn = f"substring({x}, 1, 3) not in ('000', '666') and {x} not like '9%' and substring({x}, 5, 2) <> '00' and substring({x}, 8, 4) <> '0000'"
        return f"""case when contains({x}, '@') and {is_(EMAIL)} then 'email'
            when {is_(CARD)} and length({d}) between 13 and 19 and {self.luhn_sum(d, 0)} % 10 = 0 then 'card'
            when {is_(IPV4)} then if({octets}, 'ipv4', null)
            when {is_(DATE)} then if({day}, 'date', null)
            when {is_(SSN)} then if({ssn}, 'ssn', null)
            when {is_(PHONE)} then 'phone' when {is_(ABROAD)} then 'abroad'
            when {is_(KEY_ID)} then 'key_id'
            when {is_(CARD)} then null else 'secret' end"""

    def replaced(self, kind: str, x: str) -> str:
        key_id = f"concat(left({x}, 4), {self.letters('key', f'substring({x}, 5)')})"
        return f"""case {kind} when 'email' then {self.email(x)} when 'card' then {self.card(x)} when 'ipv4' then {self.ipv4(x)}
            when 'date' then {self.date(x)} when 'ssn' then {self.ssn(x)} when 'phone' then {self.phone(x)} when 'abroad' then {self.abroad(x)}
            when 'key_id' then {key_id} when 'secret' then {self.letters('secret', x)} else {x} end"""


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """docs with the personal data in text_col replaced; all columns stay. found_col names a further column with the array of
    (kind, value, pseudonym) in the order of the text.

    Null text stays null (found: empty). Texts without a digit, "@", "=" or ":" are not searched, since no kind lacks all of
    these. Each value is treated alone: a text with n values costs n permutations, and nothing is shuffled. The domain of an
    address stays, and so do letters beyond A to Z and marks in addresses and secrets. Secrets are runs of 8 or more characters
    without quotes, commas, brackets, "&", "?" and "=". Not found: IPv6 addresses, addresses whose domain has other
    letters than A to Z, and secrets without a keyword. Rows may repeat, ids be null and other columns have any name; no rows give none.
    """
    p = Pseudonyms(key)
    text = f"cast(`{text_col}` as string)"
    maybe = f"{text} rlike '[0-9@=:]'"
    none = "cast(array() as array<struct<kind: string, value: string, pseudonym: string>>)"
    pattern = _quoted(ALL)
    own = lambda name: name if name not in docs.columns else own(f"_{name}")
    raw, done = own("__values"), own("__found")
    values = f"if({maybe}, regexp_extract_all({text}, {pattern}, 0), cast(array() as array<string>))"
    found = f"transform(transform({raw}, v -> named_struct('kind', {p.kind('v')}, 'value', v)), x -> named_struct('kind', x.kind, 'value', x.value, 'pseudonym', {p.replaced('x.kind', 'x.value')}))"
    out = docs.withColumn(raw, F.expr(f"coalesce({values}, cast(array() as array<string>))"))
    out = out.withColumn(done, F.expr(f"if(size({raw}) = 0, {none}, {found})"))
    gaps = f"split({text}, {pattern}, -1)"
    joined = f"array_join(zip_with({gaps}, {done}, (g, f) -> concat(g, coalesce(f.pseudonym, ''))), '')"
    out = out.withColumn(text_col, F.expr(f"if(size({done}) = 0, {text}, {joined})"))
    if found_col:
        out = out.withColumn(found_col, F.filter(done, lambda f: f["kind"].isNotNull()))
    return out.drop(raw, done)

