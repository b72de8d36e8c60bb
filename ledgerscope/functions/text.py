"""Column expressions for untidy text: missing markers, lists, numbers, times and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that means "no value".
MISSING = ("", "none", "null", "nan")


def nullify(col: Column, markers: tuple[str, ...] = MISSING) -> Column:
    return F.when(F.lower(F.trim(col)).isin(*markers), None).otherwise(F.trim(col))


def parse_list(col: Column) -> Column:
    """Text to array<string>: JSON array, JSON object values, or split on the first of | ; , present."""
    text = F.trim(col)
    boxed = text.startswith("[") & text.endswith("]")
    braced = text.startswith("{") & text.endswith("}")

    def parts(pattern: str) -> Column:
        return F.filter(F.transform(F.split(text, pattern), lambda x: F.trim(x)), lambda x: x != "")

    split = (
        F.when(text.contains("|"), parts(r"\|"))
        .when(text.contains(";"), parts(";"))
        .when(text.contains(","), parts(","))
        .otherwise(F.array(text))
    )
    as_array = F.when(boxed, F.from_json(text, "array<string>"))
    as_object = F.when(braced, F.map_values(F.from_json(text, "map<string,string>")))
    empty = F.array().cast("array<string>")
    blank = col.isNull() | F.lower(text).isin("", "none", "null", "[]")
    return F.when(blank, empty).otherwise(F.coalesce(as_array, as_object, split))


_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def number(text: Column) -> Column:
    """Text as a double, null for other text. A cast alone would also take type suffixes such as ``5d``."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def parse_numbers(items: Column) -> Column:
    """array<string> to array<double>; what is not a number is dropped."""
    return F.filter(F.transform(items, number), lambda x: x.isNotNull())


def parse_timestamp(col: Column) -> Column:
    """Epoch seconds, epoch milliseconds (above 1e11), ISO text or yyyy/MM/dd text, read as UTC.

    Text without a whole date is refused: a time of day would become one of the day the job runs.
    """
    text = F.trim(col)
    value = number(text)
    seconds = F.when(value > 1e11, value / 1000.0).otherwise(value)
    from_number = F.when(
        F.abs(seconds) < 2.6e11, F.timestamp_micros(F.round(seconds * 1e6).try_cast("bigint"))
    )
    dated = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    return F.when(value.isNotNull(), from_number).otherwise(
        F.coalesce(dated, F.try_to_timestamp(text, F.lit("yyyy/MM/dd HH:mm:ss")))
    )


def parse_port(col: Column) -> Column:
    number = F.trim(col.cast("string")).try_cast("int")
    return F.when(number.between(0, 65535), number)


def port_ok(col: Column) -> Column:
    text = F.lower(F.trim(col.cast("string")))
    return col.isNull() | text.isin("", "null", "none") | parse_port(col).isNotNull()


_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"{_OCTET}(\.{_OCTET}){{3}}"
_IPV4 = rf"^{_QUAD}$"
_HEX = "[0-9a-f]{1,4}"


def _scope(text: Column) -> Column:
    """The zone after '%' of an address, with the sign; empty without one."""
    return F.regexp_extract(text, "^[^%]*:[^%]*(%[^%]+)$", 1)


def _ipv6_groups(text: Column) -> Column:
    """An address without its zone, and with a dotted tail written as two groups."""
    bare = F.when(_scope(text) != "", F.substring_index(text, "%", 1)).otherwise(text)
    tail = F.regexp_extract(bare, rf"^.*:({_QUAD})$", 1)
    value = ipv4_number(tail)
    high, low = F.lower(F.hex(F.shiftright(value, 16))), F.lower(F.hex(value.bitwiseAND(0xFFFF)))
    front = F.substring(bare, F.lit(1), F.length(bare) - F.length(tail))
    return F.when(value.isNull(), bare).otherwise(F.concat(front, high, F.lit(":"), low))


def _ipv6_ok(text: Column) -> Column:
    """Eight groups, or fewer around a single '::'; the last two may be dotted, and a zone may follow."""

    def whole_or_short(plain: Column) -> Column:
        whole = plain.rlike(rf"^{_HEX}(:{_HEX}){{7}}$")
        short = plain.rlike(rf"^({_HEX}(:{_HEX})*)?::({_HEX}(:{_HEX})*)?$")
        groups = F.size(F.filter(F.split(plain, ":"), lambda g: g != ""))
        return whole | (short & (groups <= 7))

    # Bound in a lambda, so the parts are made once, and only for text with a colon.
    return text.contains(":") & F.get(F.transform(F.array(_ipv6_groups(text)), whole_or_short), F.lit(0))


def _ipv6_canonical(text: Column) -> Column:
    """All eight groups without leading zeros, then the first longest run of zero groups as '::'; the zone stays."""
    scope = _scope(text)

    def spelled_out(bare: Column) -> Column:
        left = F.filter(F.split(F.substring_index(bare, "::", 1), ":"), lambda g: g != "")
        right = F.filter(F.split(F.substring_index(bare, "::", -1), ":"), lambda g: g != "")
        fill = F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right))
        groups = F.when(bare.contains("::"), F.concat(left, fill, right)).otherwise(F.split(bare, ":"))
        return F.array_join(F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")

    plain = F.get(F.transform(F.array(_ipv6_groups(text)), spelled_out), F.lit(0))

    def squeeze(p: Column) -> Column:
        runs = F.regexp_extract_all(p, F.lit(r"(?:^|(?<=:))0(?::0)+(?=:|$)"), F.lit(0))
        longest = F.array_max(F.transform(runs, lambda r: F.length(r)))
        more = F.floor(longest / 2).cast("string")
        pattern = F.concat(F.lit("^(.*?)(?:^|:)0(?::0){"), more, F.lit("}(?:$|:)(.*)$"))
        return F.when(longest.isNull(), p).otherwise(F.regexp_replace(p, pattern, F.lit("$1::$2")))

    return F.concat(F.get(F.transform(F.array(plain), squeeze), F.lit(0)), scope)


def ip_ok(col: Column) -> Column:
    text = F.lower(F.trim(col))
    return F.coalesce(text.rlike(_IPV4) | _ipv6_ok(text), F.lit(False))


def normalize_ip(col: Column) -> Column:
    """Canonical text of a valid address, other text lower-cased as it is, missing as null."""
    text = F.lower(F.trim(col))
    missing = col.isNull() | text.isin("", "none", "null")
    return F.when(missing, None).when(_ipv6_ok(text), _ipv6_canonical(text)).otherwise(text)


def clean_ip(col: Column) -> Column:
    """Case-file addresses: a trailing :port is cut, anything invalid becomes 0.0.0.0."""
    text = F.trim(col)
    bare = F.when(text.rlike(r"^[^:\[]*:[0-9]+$"), F.substring_index(text, ":", 1)).otherwise(text)
    return F.when(ip_ok(bare), normalize_ip(bare)).otherwise(F.lit("0.0.0.0"))


def ipv4_number(col: Column) -> Column:
    """IPv4 text as a long, null for other text."""
    parts = F.split(col, r"\.")
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p.try_cast("long"))
    return F.when(col.rlike(_IPV4), value)


def entity_type(col: Column) -> Column:
    """Kind of entity an investigator's id refers to."""
    digits_dot = col.contains(".") & col.rlike("[0-9]")
    legacy = (F.length(col) >= 25) & (col.startswith("1") | col.startswith("3"))
    return (
        F.when(col.startswith("wallet:") | col.startswith("bc1") | col.startswith("tb1") | legacy, "wallet")
        .when(col.startswith("transaction:") | col.startswith("tx_") | col.rlike("^[0-9a-fA-F]{64}$"), "transaction")
        .when(col.startswith("ip:") | digits_dot, "ip")
        .when(col.startswith("asn:") | col.startswith("AS"), "asn")
        .when(col.startswith("country:"), "country")
        .otherwise("wallet")
    )


def as_percent(col: Column) -> Column:
    """Scores stored as fractions brought to the 0-100 scale."""
    return F.when(col <= 1.0, col * 100.0).otherwise(col)


def headline(feature: Column) -> Column:
    """Short title of a reason: the rule name, or the feature name in words."""
    words = F.initcap(F.replace(feature, F.lit("_"), F.lit(" ")))
    bare = F.replace(feature, F.lit("RULE_"), F.lit(""))
    title = F.when(feature.startswith("RULE_"), bare).otherwise(words)
    return F.when(F.coalesce(title, F.lit("")) == "", "Forensic Finding").otherwise(title)
