"""String, regular expression, path, network, quoting and codec functions as Columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# strings


def contains(s, sub): return F.contains(s, F.lit(sub))  # noqa: E704
def has_prefix(s, p): return F.startswith(s, F.lit(p))  # noqa: E704
def has_suffix(s, p): return F.endswith(s, F.lit(p))  # noqa: E704
def index(s: Column, sub: str) -> Column: return F.when(F.instr(s, sub) > 0, F.octet_length(F.substring_index(s, sub, 1))).otherwise(-1)  # noqa: E704
def last_index(s: Column, sub: str) -> Column: return F.when(F.instr(s, sub) > 0, F.octet_length(s) - F.octet_length(F.substring_index(s, sub, -1)) - len(sub.encode())).otherwise(-1)  # noqa: E704
def count(s: Column, sub: str) -> Column: return F.floor((F.length(s) - F.length(F.replace(s, F.lit(sub), F.lit("")))) / len(sub)).cast("long") if sub else F.length(s).cast("long") + 1  # noqa: E704
def repeat(s, n): return F.repeat(s, n)  # noqa: E704
def to_upper(s): return F.upper(s)  # noqa: E704
def to_lower(s): return F.lower(s)  # noqa: E704
def trim_space(s): return F.regexp_replace(s, r"^[\s\u0085\u00a0]+|[\s\u0085\u00a0]+\z", "")  # noqa: E704
def trim(s: Column, cut: str) -> Column: return F.btrim(s, F.lit(cut))  # noqa: E704
def trim_left(s: Column, cut: str) -> Column: return F.ltrim(s, F.lit(cut))  # noqa: E704
def trim_right(s: Column, cut: str) -> Column: return F.rtrim(s, F.lit(cut))  # noqa: E704
def trim_prefix(s: Column, p: str) -> Column: return F.when(F.startswith(s, F.lit(p)), F.substring(s, len(p) + 1, 1 << 30)).otherwise(s)  # noqa: E704
def trim_suffix(s: Column, p: str) -> Column: return F.when(F.endswith(s, F.lit(p)), F.left(s, F.length(s) - len(p))).otherwise(s)  # noqa: E704
def replace_all(s: Column, old: str, new: str) -> Column: return F.replace(s, F.lit(old), F.lit(new))  # noqa: E704
def split(s: Column, sep: str) -> Column: return F.split(s, F.lit(r"\Q" + sep + r"\E")) if sep else F.split(s, "")  # noqa: E704
def fields(s: Column) -> Column: return F.filter(F.split(s, r"\s+"), lambda x: x != "")  # noqa: E704
def join(a: Column, sep: str) -> Column: return F.array_join(a, sep)  # noqa: E704
def min_runes(s: Column, n: int) -> Column: return F.char_length(s) >= n  # noqa: E704
def max_runes(s: Column, n: int) -> Column: return F.char_length(s) <= n  # noqa: E704
def slice_runes(s: Column, lo: int, hi: int) -> Column: return F.substring(s, lo + 1, hi - lo)  # noqa: E704
def runes(s: Column) -> Column: return F.transform(F.split(s, ""), lambda c: F.ascii(c))  # noqa: E704
def to_title(s: Column) -> Column: return _cased(s, F.upper)  # noqa: E704
def to_camel(s: Column) -> Column: return _cased(s, F.lower)  # noqa: E704
def _cased(s: Column, f) -> Column:
    """The first letter of every word, in the case of ``f``."""
    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(r"(\s*\S*)"), 1), lambda w: F.concat(F.regexp_extract(w, r"^(\s*)", 1), f(F.regexp_extract(w, r"^\s*(\S?)", 1)), F.regexp_extract(w, r"^\s*\S?([\s\S]*)\z", 1))), "")
def compare(a: Column, b: Column) -> Column: return F.when(a < b, -1).when(a > b, 1).otherwise(0)  # noqa: E704


# regular expressions (linear-time dialect: no lookaround or back references)


def linear(pattern: str) -> str:
    """The pattern, if the dialect has it: lookaround, back references and possessive or atomic groups are refused."""
    bare = re.sub(r"\\[^1-9]|\[(?:\\.|[^\]\\])+\]", "x", pattern)
    if found := re.search(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|[*+?}]\+", bare):
        raise ValueError(f"not in the dialect: {found[0]} of {pattern}")
    return re.sub(r"\(\?P<", "(?<", pattern)


def _group(name: str, pattern: str) -> str:
    """What stands for a group in a replacement; an unknown one is empty."""
    names = {n: i + 1 for i, n in enumerate(re.findall(r"(?<!\\)\((?:\?P?<(\w+)>|(?!\?))", pattern)) if n}
    n = int(name) if name.isdigit() else names.get(name)
    return f"${n}" if n is not None and n <= re.compile(re.sub(r"\(\?<(?=\w)", "(?P<", pattern)).groups else ""


def find_named(s: Column, pattern: str) -> Column:
    """The named groups of the first match, as a struct; null if there is none."""
    names = re.findall(r"\(\?P?<(\w+)>", pattern)
    groups = re.compile(re.sub(r"\(\?<(?=\w)", "(?P<", pattern)).groupindex
    return F.when(match(s, pattern), F.struct(*[F.regexp_extract(s, linear(pattern), groups[n]).alias(n) for n in names]))
def regexp_valid(pattern: str) -> bool:
    try:
        re.compile(linear(pattern).replace("(?<", "(?P<"))
    except (re.error, ValueError):
        return False
    return True
def find_all_submatch(s: Column, pattern: str, groups: int, n: int = -1) -> Column:
    """Of every match the groups, the whole first."""
    out = F.arrays_zip(*[F.regexp_extract_all(s, F.lit(linear(pattern)), i).alias(f"g{i}") for i in range(groups + 1)])
    out = F.transform(out, lambda z: F.array(*[z[f"g{i}"] for i in range(groups + 1)]))
    return out if n < 0 else F.slice(out, 1, n)

def find(s: Column, pattern: str) -> Column: return F.regexp_substr(s, F.lit(linear(pattern)))  # noqa: E704
def find_all(s: Column, pattern: str, n: int = -1) -> Column:
    all_ = F.regexp_extract_all(s, F.lit(linear(pattern)), 0)
    return all_ if n < 0 else F.slice(all_, 1, n)
def find_submatch(s: Column, pattern: str, groups: int) -> Column: return F.when(s.rlike(pattern), F.array(*[F.regexp_extract(s, pattern, i) for i in range(groups + 1)]))  # noqa: E704
def regexp_replace_all(s: Column, pattern: str, new: str) -> Column:
    """$1, ${1} and ${name} stand for groups, $$ for a dollar sign."""
    out = re.sub(r"\$\$|\$\{(\w+)\}|\$(\w+)|\\", lambda m: r"\$" if m[0] == "$$" else r"\\" if m[0] == "\\" else _group(m[1] or m[2], pattern), new)
    return F.regexp_replace(s, linear(pattern), out)
def regexp_replace_literal(s: Column, pattern: str, new: str) -> Column: return F.regexp_replace(s, pattern, new.replace("\\", "\\\\").replace("$", "\\$"))  # noqa: E704
def match(s: Column, pattern: str) -> Column: return s.rlike(linear(pattern))  # noqa: E704
def quote_meta(s: Column) -> Column: return F.regexp_replace(s, r"([\\.+*?()|\[\]{}^$])", r"\\$1")  # noqa: E704


# codecs and digests: binary like the text's bytes, hex where it says so


def md5(s): return F.unhex(F.md5(s))  # noqa: E704
def sha1(s): return F.unhex(F.sha1(s))  # noqa: E704
def sha2(s, bits): return F.unhex(F.sha2(s, bits))  # noqa: E704
def base64_encode(s): return F.base64(s.cast("binary"))  # noqa: E704
def base64_decode(s): return F.when(s.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"), F.unbase64(s))  # noqa: E704
def hex_encode(s): return F.lower(F.hex(s))  # noqa: E704
def hex_decode(s): return F.when(s.rlike(r"^(?:[0-9a-fA-F]{2})*\z"), F.unhex(s))  # noqa: E704
def query_escape(s): return F.replace(F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))  # noqa: E704
def query_unescape(s): return F.try_url_decode(s)  # noqa: E704
def path_escape(s: Column) -> Column:
    out = F.replace(query_escape(s), F.lit("+"), F.lit("%20"))
    for c in "$&+=:@":  # what a segment of a path may have
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


#: The characters that HTML text escapes.
HTML = (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"))


def html_escape(s: Column) -> Column:
    for a, b in HTML:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def html_unescape(s: Column) -> Column:
    """The five that html_escape makes."""
    for a, b in reversed(HTML):
        s = F.replace(s, F.lit(b), F.lit(a))
    return s


def hmac_sign(algorithm: str):
    """(key, message) -> bytes."""
    import hashlib
    import hmac

    def sign(key: pd.Series, message: pd.Series) -> pd.Series:
        return pd.Series([None if k is None or m is None else hmac.new(k.encode(), m.encode(), getattr(hashlib, algorithm.lower())).digest() for k, m in zip(key, message, strict=True)])

    return F.pandas_udf(sign, "binary")


# JSON


def json_valid(s): return F.try_parse_json(s).isNotNull()  # noqa: E704
def json_marshal(c): return F.to_json(c)  # noqa: E704
def json_unmarshal(s): return F.try_parse_json(s)  # noqa: E704
def json_field(s: Column, path: str, kind: str) -> Column: return F.try_variant_get(F.try_parse_json(s), path, kind)  # noqa: E704


# paths and URLs


def path_base(s: Column) -> Column:
    t = F.regexp_replace(s, "/+\\z", "")
    return F.when(s == "", ".").when(t == "", "/").otherwise(F.substring_index(t, "/", -1))
def path_dir(s: Column) -> Column: return path_clean(F.regexp_extract(s, r"^([\s\S]*/)?", 1))  # noqa: E704
def path_ext(s: Column) -> Column: return F.regexp_extract(s, r"(\.[^./]*)\z", 1)  # noqa: E704
def path_is_abs(s): return F.startswith(s, F.lit("/"))  # noqa: E704
def path_clean(s: Column) -> Column:
    """The shortest path of the same place: no empty or "." steps, and ".." undoes the step before it."""
    rooted = F.startswith(s, F.lit("/"))
    steps = F.filter(F.split(s, "/"), lambda x: (x != "") & (x != "."))

    def step(done: Column, x: Column) -> Column:
        undo = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        return F.when(x != "..", F.concat(done, F.array(x))).when(undo, F.slice(done, F.lit(1), F.size(done) - 1)).when(rooted, done).otherwise(F.concat(done, F.array(x)))

    out = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), out)).when(out == "", ".").otherwise(out)
def path_join(*parts: Column) -> Column:
    """Steps joined, empty ones left out, and cleaned; empty if all are."""
    given = F.filter(F.array(*parts), lambda x: x != "")
    return F.when(F.size(given) > 0, path_clean(F.array_join(given, "/"))).otherwise("")
def path_split(s: Column) -> Column: return F.array(F.regexp_extract(s, r"^([\s\S]*/)?", 1), F.regexp_extract(s, r"([^/]*)\z", 1))  # noqa: E704
def path_split_list(s: Column) -> Column: return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ":"))  # noqa: E704
def path_to_slash(s: Column) -> Column: return s  # noqa: E704
def path_resolve(a: Column, b: Column) -> Column: return F.when(path_is_abs(b), path_clean(b)).otherwise(path_join(a, b))  # noqa: E704
def path_rel(base: Column, to: Column) -> Column:
    """The way from one cleaned path to another; null if one is rooted and the other is not, or a ".." is in the way."""
    parts = lambda p: F.filter(F.split(path_clean(p), "/"), lambda x: (x != "") & (x != "."))
    a, b = parts(base), parts(to)
    same = F.aggregate(F.arrays_zip(a.alias("a"), b.alias("b")), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda t, z: F.when(t["on"] & F.coalesce(z["a"] == z["b"], F.lit(False)), F.struct((t["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(t["n"].alias("n"), F.lit(False).alias("on"))), lambda t: t["n"])
    up = F.slice(a, same + 1, F.size(a))
    out = F.concat(F.transform(up, lambda _: F.lit("..")), F.slice(b, same + 1, F.size(b)))
    return F.when((path_is_abs(base) == path_is_abs(to)) & ~F.array_contains(up, ".."), F.when(F.size(out) == 0, ".").otherwise(F.array_join(out, "/")))
def path_match(s: Column, pattern: str) -> Column:
    """Shell patterns: * and ? stop at a slash, classes of characters in brackets."""
    out = re.sub(r"\\(.)|(\*)|(\?)|(\[\^?(?:\\.|[^\]\\])+\])|(.)", lambda m: re.escape(m[1]) if m[1] else "[^/]*" if m[2] else "[^/]" if m[3] else m[4] or re.escape(m[5]), pattern)
    return s.rlike(rf"^{out}\z")


def url_valid(s: Column) -> Column: return s.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]*\z|^[^\s:]*\z")  # noqa: E704
def abs_url(s: Column) -> Column: return s.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+\z")  # noqa: E704
def url_host(s): return F.try_parse_url(s, F.lit("HOST"))  # noqa: E704
def join_host_port(host: Column, port: Column) -> Column: return F.concat(F.when(F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host), F.lit(":"), port.cast("string"))  # noqa: E704
def path_unescape(s: Column) -> Column: return F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))  # noqa: E704
def split_host_port(s: Column) -> Column: return F.array(F.regexp_extract(s, r"^\[?([^\]]*?)\]?:([0-9]*)\z", 1), F.regexp_extract(s, r"^\[?([^\]]*?)\]?:([0-9]*)\z", 2))  # noqa: E704
def ipv4(s: Column) -> Column: return s.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!\z)|\z)){4}\z")  # noqa: E704
def loopback_ip(s: Column) -> Column: return F.coalesce(ipv4_number(s).between(127 << 24, (128 << 24) - 1), F.lit(False)) | (s == "::1")  # noqa: E704
def multicast_ip(s: Column) -> Column: return F.coalesce(ipv4_number(s).between(224 << 24, (240 << 24) - 1), F.lit(False)) | s.rlike("(?i)^ff[0-9a-f]{2}:")  # noqa: E704
def link_local_ip(s: Column) -> Column: return F.coalesce(ipv4_number(s).between((169 << 24) + (254 << 16), (169 << 24) + (255 << 16) - 1), F.lit(False)) | s.rlike("(?i)^fe[89ab][0-9a-f]:")  # noqa: E704
def unspecified_ip(s: Column) -> Column: return s.isin("0.0.0.0", "::")  # noqa: E704
def ip_string(n: Column) -> Column: return F.concat_ws(".", *[F.shiftright(n, 8 * i).bitwiseAND(255).cast("string") for i in (3, 2, 1, 0)])  # noqa: E704
def add_ip(s: Column, n) -> Column: return F.when((ipv4_number(s) + n).between(0, (1 << 32) - 1), ip_string(ipv4_number(s) + n))  # noqa: E704
def compare_ip(a: Column, b: Column) -> Column: return F.signum((ipv4_number(a) - ipv4_number(b)).cast("double")).cast("int")  # noqa: E704
def fqdn(s: Column) -> Column: return (F.length(s) <= 253) & s.rlike(r"^(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)*[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\z")  # noqa: E704
def ipv4_number(s: Column) -> Column:
    p = F.split(s, r"\.")
    return F.when(ipv4(s), sum((F.get(p, i).try_cast("long") * (1 << (24 - 8 * i)) for i in range(1, 4)), F.get(p, 0).try_cast("long") * (1 << 24)))
def in_cidr(s: Column, cidr: str) -> Column:
    import ipaddress

    net = ipaddress.ip_network(cidr, strict=False)
    return ipv4_number(s).between(int(net.network_address), int(net.broadcast_address))


# uuid


def uuid_valid(s: Column) -> Column: return s.rlike(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z")  # noqa: E704
def uuid_version(s: Column) -> Column: return F.when(uuid_valid(s), F.conv(F.substring(s, 15, 1), 16, 10).cast("int"))  # noqa: E704


def uuid_named(space: str, version: int):
    """Name-based UUIDs: version 3 (MD5) or 5 (SHA-1) in the name space of a UUID, built from the digest."""
    raw = F.unhex(F.lit(space.replace("-", "")))

    def make(name: Column) -> Column:
        data = F.concat(raw, name.cast("binary"))
        h = F.lower(F.md5(data) if version == 3 else F.sha1(data))
        kind = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
        return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit(str(version)), F.substring(h, 14, 3)), F.concat(kind, F.substring(h, 18, 3)), F.substring(h, 21, 12))

    return make


# bytes, sets of characters and pieces


def _any_of(chars: str) -> str: return "".join("\\" + c if c.isascii() and not c.isalnum() else c for c in chars)  # noqa: E704
def contains_any(s: Column, chars: str) -> Column: return F.length(F.translate(s, chars, "")) < F.length(s)  # noqa: E704
def index_any(s: Column, chars: str) -> Column:
    """Byte offset of the first character of a set; -1 without one."""
    has = contains_any(s, chars)
    return F.when(has, F.octet_length(F.regexp_extract(s, f"^[^{_any_of(chars)}]*", 0)) if chars else F.lit(-1)).when(~has, -1)
def last_index_any(s: Column, chars: str) -> Column:
    has = contains_any(s, chars)
    return F.when(has, F.octet_length(F.regexp_extract(s, rf"^([\s\S]*)[{_any_of(chars)}]", 1)) if chars else F.lit(-1)).when(~has, -1)
def split_n(s: Column, sep: str, n: int) -> Column:
    """At most n pieces, the last with the rest; all if n is negative. An empty separator parts characters."""
    if n == 0:
        return F.when(s.isNotNull(), F.array().cast("array<string>"))
    if sep:
        return F.split(s, r"\Q" + sep + r"\E", n)
    runes_ = F.filter(F.split(s, ""), lambda c: c != "")
    if n < 0:
        return runes_
    return F.when(F.size(runes_) <= n, runes_).otherwise(F.concat(F.slice(runes_, 1, n - 1), F.array(F.substring(s, n, 1 << 30))))
def split_after(s: Column, sep: str, n: int = -1) -> Column:
    """Like split_n, and every piece but the last keeps the separator behind it."""
    p = split_n(s, sep, n)
    return F.transform(p, lambda x, i: F.when(i < F.size(p) - 1, F.concat(x, F.lit(sep))).otherwise(x))
def byte_at(s: Column, i: int) -> Column: return F.when(F.octet_length(s) > i, F.conv(F.hex(F.substring(s.cast("binary"), i + 1, 1)), 16, 10).cast("int"))  # noqa: E704
def byte_slice(s: Column, lo: int, hi: int) -> Column: return F.when(F.octet_length(s) >= hi, F.substring(s.cast("binary"), lo + 1, hi - lo))  # noqa: E704
def base64_encoded_len(n: Column) -> Column: return F.call_function("div", n + 2, F.lit(3)) * 4  # noqa: E704
def base64_decoded_len(n: Column) -> Column: return F.call_function("div", n, F.lit(4)) * 3  # noqa: E704
def hex_encoded_len(n: Column) -> Column: return n * 2  # noqa: E704
def hex_decoded_len(n: Column) -> Column: return F.call_function("div", n, F.lit(2))  # noqa: E704
def json_compact(s: Column) -> Column:
    """White space outside of strings removed; null if it is not JSON."""
    return F.when(json_valid(s), F.regexp_replace(s, r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|\s+', "$1"))
def csv_encode(rows: Column) -> Column:
    """A list of lists of strings as CSV lines; fields with commas, quotes, line ends or a space in front are quoted, nulls are empty."""
    field = lambda v: F.when(v.rlike(r'[,"\r\n]|\A[ \t]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(v, F.lit("")))
    return F.array_join(F.transform(rows, lambda row: F.concat(F.array_join(F.transform(row, field), ","), F.lit("\n"))), "")
def json_html_escape(s: Column) -> Column:
    for c in "<>&\u2028\u2029":
        s = F.replace(s, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return s
def quote_to_ascii(quoted: Column) -> Column:
    """Of a quoted text, what is not ASCII as \\u or \\U and the code point."""
    point = lambda c: F.lower(F.hex(F.ascii(c)))
    return F.array_join(F.transform(F.split(quoted, ""), lambda c: F.when(F.ascii(c) < 128, c).when(F.ascii(c) < 65536, F.concat(F.lit("\\u"), F.lpad(point(c), 4, "0"))).otherwise(F.concat(F.lit("\\U"), F.lpad(point(c), 8, "0")))), "")


# addresses of both families


def ipv6(s: Column) -> Column:
    """Eight groups of hexadecimal digits, one run of zeros left out as "::"; the last two may be written as IPv4."""
    tail = F.regexp_extract(s, r":([0-9.]*\.[0-9.]*)\z", 1)
    t = F.when(ipv4(tail), F.regexp_replace(s, r"[0-9.]+\z", "0:0")).otherwise(s)
    groups = F.filter(F.split(t, ":"), lambda x: x != "")
    short = F.contains(t, F.lit("::"))
    plain = t.rlike(r"^[0-9a-fA-F:]+\z") & F.forall(groups, lambda x: F.length(x) <= 4) & ~t.rlike(r":::|::.*::|^:[^:]|[^:]:\z")
    return plain & F.when(short, F.size(groups) <= 7).otherwise((F.size(groups) == 8) & (F.size(F.split(t, ":")) == 8))
def ip(s: Column) -> Column: return ipv4(s) | ipv6(s)  # noqa: E704
def ip_cidr(s: Column) -> Column:
    address, bits = F.substring_index(s, "/", 1), F.regexp_extract(s, r"^[^/]*/(0|[1-9][0-9]{0,2})\z", 1).try_cast("int")
    return F.coalesce((ipv4(address) & (bits <= 32)) | (ipv6(address) & (bits <= 128)), F.lit(False))
def to_ip4(s: Column) -> Column: return F.when(ipv4(s), F.transform(F.split(s, r"\."), lambda x: x.try_cast("int")))  # noqa: E704
def global_unicast_ip(s: Column) -> Column: return ip(s) & ~(loopback_ip(s) | multicast_ip(s) | link_local_ip(s) | unspecified_ip(s) | (s == "255.255.255.255"))  # noqa: E704


# more of uuid


UUID_FORMS = r"^(?:(?i:urn:uuid:)?H{8}(?:-H{4}){3}-H{12}|\{H{8}(?:-H{4}){3}-H{12}\}|H{32})\z".replace("H", "[0-9a-fA-F]")


def uuid_parse(s: Column) -> Column:
    """The usual form, in lower case, of a UUID as a URN, in braces, without hyphens or as usual; null for any other text."""
    h = F.regexp_replace(F.lower(s), r"^urn:uuid:|[{}-]", "")
    return F.when(s.rlike(UUID_FORMS), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
def uuid_urn(s: Column) -> Column: return F.concat(F.lit("urn:uuid:"), uuid_parse(s))  # noqa: E704
def uuid_variant(s: Column) -> Column:
    """1 as in RFC 4122, 3 Microsoft's, 4 for the future, 2 reserved; null if it is none."""
    c = F.substring(uuid_parse(s), 20, 1)
    return F.when(c.isin(*"89ab"), 1).when(c.isin(*"cd"), 3).when(c.isin(*"ef"), 4).when(c.isNotNull(), 2)
