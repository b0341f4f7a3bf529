"""Functions by package and name, for callers that look them up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arithmetic as A
from . import numbers as N
from . import text as X

#: Of real numbers; most are Spark's own.
MATH: dict[str, Callable[..., Column]] = {
    "Abs": F.abs, "Acos": F.acos, "Acosh": F.acosh, "Asin": F.asin, "Asinh": F.asinh, "Atan": F.atan, "Atan2": F.atan2, "Atanh": F.atanh, "Cbrt": F.cbrt, "Ceil": F.ceil, "Copysign": N.copysign, "Cos": F.cos, "Cosh": F.cosh,
    "Dim": N.dim, "Erf": lambda x: N.from_math("erf")(x), "Erfc": lambda x: N.from_math("erfc")(x), "Exp": F.exp, "Exp2": N.exp2, "Expm1": F.expm1, "Floor": F.floor, "Gamma": lambda x: N.from_math("gamma")(x), "Hypot": F.hypot, "Ldexp": N.ldexp, "Log": F.log, "Log10": F.log10,
    "Log1p": F.log1p, "Log2": F.log2, "Logb": N.logb, "Ilogb": lambda x: N.logb(x).cast("int"), "Mod": lambda x, y: F.try_mod(x, y), "MultipleOf": N.multiple_of, "Pow": F.pow, "Pow10": lambda n: F.pow(F.lit(10.0), n),
    "Remainder": lambda x, y: x - y * F.rint(x / y), "Round": N.round_half_away, "RoundToEven": N.round_to_even, "Signbit": N.signbit, "Sin": F.sin, "Sinh": F.sinh, "Sqrt": F.sqrt, "Tan": F.tan, "Tanh": F.tanh, "Trunc": N.trunc,
}
BITS = {"And": lambda x, y: x.bitwiseAND(y), "Or": lambda x, y: x.bitwiseOR(y), "Xor": lambda x, y: x.bitwiseXOR(y), "Clear": N.bit_clear, "Lsh": N.lsh, "Rsh": N.rsh, "At": N.bit_at, "Set": N.bit_set, "OnesCount": N.ones_count, "Len": N.bit_len}
PATH = {"Split": X.path_split, "SplitList": X.path_split_list, "Join": X.path_join, "Match": X.path_match, "Clean": X.path_clean, "ToSlash": X.path_to_slash, "FromSlash": X.path_to_slash, "Ext": X.path_ext, "Resolve": X.path_resolve, "Rel": X.path_rel, "Base": X.path_base, "Dir": X.path_dir, "IsAbs": X.path_is_abs}
STRINGS = {
    "ByteAt": X.byte_at, "ByteSlice": X.byte_slice, "Runes": X.runes, "MinRunes": X.min_runes, "MaxRunes": X.max_runes, "ToTitle": X.to_title, "ToCamel": X.to_camel, "SliceRunes": X.slice_runes, "Compare": X.compare, "Count": X.count, "Contains": X.contains,
    "ContainsAny": X.contains_any, "LastIndex": X.last_index, "IndexAny": X.index_any, "LastIndexAny": X.last_index_any, "SplitN": X.split_n, "SplitAfterN": X.split_after, "Split": X.split, "SplitAfter": X.split_after, "Fields": X.fields, "Join": X.join,
    "HasPrefix": X.has_prefix, "HasSuffix": X.has_suffix, "Repeat": X.repeat, "ToUpper": X.to_upper, "ToLower": X.to_lower, "Trim": X.trim, "TrimLeft": X.trim_left, "TrimRight": X.trim_right, "TrimSpace": X.trim_space, "TrimPrefix": X.trim_prefix, "TrimSuffix": X.trim_suffix, "Replace": X.replace_all, "Index": X.index,
}
LIST = {
    "Drop": N.drop, "FlattenN": N.flatten, "Repeat": N.repeat, "Concat": N.concat, "Take": N.take, "Slice": N.slice_, "Reverse": N.reverse, "MinItems": N.min_items, "MaxItems": N.max_items, "UniqueItems": N.unique_items, "Contains": N.contains, "MatchN": N.match_n,
    "Avg": N.list_avg, "Max": N.list_max, "Min": N.list_min, "Product": N.list_product, "Range": N.range_, "Sum": N.list_sum, "Sort": lambda a, less=None: A.sort_by(a, less) if less else N.sort(a), "SortStable": A.sort_by, "SortStrings": N.sort, "IsSorted": N.is_sorted, "IsSortedStrings": N.is_sorted,
}
NET = {
    "SplitHostPort": X.split_host_port, "JoinHostPort": X.join_host_port, "FQDN": X.fqdn, "IPv4": X.ipv4, "IPv6": X.ipv6, "IP": X.ip, "IPCIDR": X.ip_cidr, "LoopbackIP": X.loopback_ip, "MulticastIP": X.multicast_ip, "GlobalUnicastIP": X.global_unicast_ip, "UnspecifiedIP": X.unspecified_ip,
    "ToIP4": X.to_ip4, "AddIP": X.add_ip, "InCIDR": X.in_cidr, "CompareIP": X.compare_ip, "PathEscape": X.path_escape, "PathUnescape": X.path_unescape, "QueryEscape": X.query_escape, "QueryUnescape": X.query_unescape, "URL": X.url_valid, "AbsURL": X.abs_url,
}
REGEXP = {"Find": X.find, "FindAll": X.find_all, "FindAllSubmatch": X.find_all_submatch, "FindNamedSubmatch": X.find_named, "FindSubmatch": X.find_submatch, "ReplaceAll": X.regexp_replace_all, "ReplaceAllLiteral": X.regexp_replace_literal, "Valid": X.regexp_valid, "Match": X.match, "QuoteMeta": X.quote_meta}
STRCONV = {"ParseBool": N.parse_bool, "FormatBool": N.format_bool, "ParseFloat": N.parse_float, "ParseInt": N.parse_int, "Atoi": N.atoi, "FormatInt": N.format_int, "Quote": N.quote, "QuoteToASCII": lambda s: X.quote_to_ascii(N.quote(s))}
TIME = {"Duration": N.duration_valid, "FormatDuration": N.format_duration, "ParseDuration": N.parse_duration, "Time": N.time_valid, "Unix": N.unix, "ToUnix": N.to_unix, "ToUnixNano": N.to_unix_nano, "Split": N.time_split}
UUID = {"Valid": X.uuid_valid, "Parse": X.uuid_parse, "URN": X.uuid_urn, "Variant": X.uuid_variant, "Version": X.uuid_version, "SHA1": lambda space: X.uuid_named(space, 5), "MD5": lambda space: X.uuid_named(space, 3)}
PACKAGES = {
    "math": MATH, "math/bits": BITS, "path": PATH, "strings": STRINGS, "list": LIST, "net": NET, "regexp": REGEXP, "strconv": STRCONV, "time": TIME, "uuid": UUID,
    "struct": {"MinFields": N.min_fields, "MaxFields": N.max_fields},
    "html": {"Escape": X.html_escape, "Unescape": X.html_unescape},
    "encoding/base64": {"EncodedLen": X.base64_encoded_len, "DecodedLen": X.base64_decoded_len, "Encode": X.base64_encode, "Decode": X.base64_decode},
    "encoding/hex": {"EncodedLen": X.hex_encoded_len, "DecodedLen": X.hex_decoded_len, "Encode": X.hex_encode, "Decode": X.hex_decode},
    "encoding/csv": {"Encode": X.csv_encode},
    "encoding/json": {"Valid": X.json_valid, "Compact": X.json_compact, "HTMLEscape": X.json_html_escape, "Marshal": X.json_marshal, "Unmarshal": X.json_unmarshal},
}


def function(package: str, name: str) -> Callable[..., Column]:
    """The function of a package; KeyError if there is none."""
    return PACKAGES[package][name]
