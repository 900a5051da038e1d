"""URL expressions: parts, resolution against a base, and private hosts."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File names that are not crawled (a fixed value).
EXCLUDED = r"(?iu)\.(?:jpg|jpeg|png|gif|ico|css|js)\z"

#: Loopback, private, link-local and unspecified networks (fixed values).
PRIVATE_NETWORKS = (
    "127.0.0.0/8",
    "::1/128",
    "10.0.0.0/8",
    "172.16.0.0/12",
    "192.168.0.0/16",
    "169.254.0.0/16",
    "fe80::/10",
    "0.0.0.0/8",
    "255.255.255.255/32",
    "fc00::/7",
)


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def excluded(url: Column) -> Column:
    return url.rlike(EXCLUDED)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host_port(url: Column) -> Column:
    """The authority without user information, with its port."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)


def host(url: Column) -> Column:
    """The host name without a port (an IPv6 literal without brackets)."""
    return F.regexp_replace(F.regexp_replace(host_port(url), r":\d*$", ""), r"[\[\]]", "")


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*", "")


def _without_dots(path: Column) -> Column:
    """`path` with its . and .. segments worked out."""
    return let(path, lambda p: F.when(p.contains("/.") | p.startswith("."), _dots_worked_out(p)).otherwise(p))


def _dots_worked_out(path: Column) -> Column:
    segments = F.split(path, "/")
    keep = F.filter(segments, lambda x, i: (x != ".") | (i == F.size(segments) - 1))
    start = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))  # never above the root
        return F.when(x == "..", up).otherwise(F.concat(done, F.array(x)))

    walked = F.aggregate(keep, start, step)
    def close(done: Column) -> Column:
        bare = F.array_join(F.filter(done, lambda x, i: (x != ".") | (i < F.size(done) - 1)), "/")
        open_end = path.rlike(r"(?:^|/)\.\.?$")
        return let(bare, lambda x: F.when(open_end & ~x.endswith("/"), F.concat(x, F.lit("/"))).otherwise(x))

    return let(walked, close)


def resolve(target: Column, base: Column) -> Column:
    """`target` against `base` by RFC 3986; null for an empty target."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), "[^/]*$", "")
    own, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(target == "", F.lit(None))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), target))
        .when(target.startswith("/"), F.concat(origin, _without_dots(own), rest))
        .when(target.startswith("?"), F.concat(origin, path, target))
        .when(target.startswith("#"), F.concat(F.regexp_replace(base, "(?s)#.*", ""), target))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, own)), rest))
    )


#: What a path may hold as it is (fixed values): all of these while nothing else is in it, those of the second set when it is written anew.
_PATH_AS_GIVEN, _PATH_PLAIN = r"^[A-Za-z0-9\-_.~!$&'()*+,;=:@\[\]%/]*\z", r"^[A-Za-z0-9\-_.~$&+,/:;=@]\z"


def parsable(url: Column) -> Column:
    """Whether an absolute URL can be parsed: no control characters, percent signs before two digits only, no space in the host, a port of digits."""
    own = F.regexp_extract(url, r"(?s)^([^?#]*)", 1)
    return ~url.rlike(r"[\x00-\x1F\x7F]") & ~own.rlike("%(?![0-9A-Fa-f]{2})") & ~host_port(url).rlike(r"[ <>\"\\^`{|}]|:(?!\d*\z)(?![^\[]*\])")


def encoded(url: Column) -> Column:
    """An absolute URL with a path that holds other characters than a path may percent-encoded; query and fragment stay as they are."""
    origin = F.regexp_extract(url, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(url, r"(?s)^[^?#]*(.*)$", 1)
    bare = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    one = lambda c: F.when(c.rlike(_PATH_PLAIN), c).otherwise(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")))
    written = F.array_join(F.transform(F.split(bare, ""), one), "")
    return F.when((origin == "") | path.rlike(_PATH_AS_GIVEN), url).otherwise(F.concat(origin, written, rest))


def _ipv4_value(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    value = F.lit(0).cast("long")
    for k in range(4):
        value = value * 256 + F.get(parts, F.lit(k)).try_cast("long")
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), value)


def _in_any(value: Column, networks: list, bound) -> Column:
    """Whether the value, worked out once, is between the bounds of a network."""
    found = lambda v: reduce(lambda a, n: a | v.between(bound(n.network_address), bound(n.broadcast_address)), networks, F.lit(False))
    return F.coalesce(F.exists(F.array(value), found), F.lit(False))


def _networks(networks: tuple[str, ...], version: int) -> list:
    return [n for n in (ipaddress.ip_network(x, strict=False) for x in networks) if n.version == version]


def private_ipv4(ip: Column, networks: tuple[str, ...] = PRIVATE_NETWORKS) -> Column:
    """Whether a dotted quad is in one of the networks; false for anything else."""
    return _in_any(_ipv4_value(ip), _networks(networks, 4), int)


#: What the 32 digits of an address of the first family begin with: the second family's form of it.
_MAPPED = "0" * 20 + "ffff"


def _ipv6_digits(ip: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 literal; null for anything else."""
    sides = F.split(F.lower(ip), "::", 2)
    groups = lambda k: F.filter(F.split(F.coalesce(F.get(sides, F.lit(k)), F.lit("")), ":"), lambda g: g != "")
    left, right = groups(0), groups(1)
    missing = F.lit(8) - F.size(left) - F.size(right)
    every = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    digits = F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), "")
    return F.when(ip.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), let(digits, lambda d: F.when(F.length(d) == 32, d)))


def _ipv4_digits(ip: Column) -> Column:
    """Eight hexadecimal digits of a dotted quad."""
    small = let(F.split(ip, r"\."), lambda parts: F.forall(parts, lambda p: p.try_cast("int") < 256))
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & small, F.lower(F.lpad(F.hex(_ipv4_value(ip)), 8, "0")))


def address_digits(ip: Column) -> Column:
    """One form for both families: 32 hexadecimal digits of an address, null for anything else.

    A dotted quad and the same address written in the second family (as
    ::ffff:10.0.0.1 or ::ffff:a00:1) have equal digits. A zone (%…) does not count.
    """
    bare = F.regexp_replace(ip, "%.*$", "")
    four = F.concat(F.lit(_MAPPED), _ipv4_digits(bare))
    tail = F.regexp_extract(bare, r":(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    ended = let(_ipv4_digits(tail), lambda d: _ipv6_digits(F.concat(F.regexp_replace(bare, r"[^:]*$", ""), F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4))))
    six = F.when(tail != "", ended).otherwise(_ipv6_digits(bare))
    return F.when(bare.contains(":"), six).when(bare.rlike(r"^[0-9.]+$"), four)


def _bounds(network) -> tuple[str, str]:
    """First and last digits of a network, in the form of `address_digits`."""
    form = (lambda a: _MAPPED + f"{int(a):08x}") if network.version == 4 else (lambda a: f"{int(a):032x}")
    return form(network.network_address), form(network.broadcast_address)


def private_ip(ip: Column, networks: tuple[str, ...] = PRIVATE_NETWORKS) -> Column:
    """Whether an address of either family is in one of the networks; false for anything else.

    An address of the first family is in networks of that family only, however it is written.
    """
    known = [ipaddress.ip_network(n, strict=False) for n in networks]

    def inside(digits: Column) -> Column:
        four = digits.startswith(_MAPPED)
        found = F.lit(False)
        for n in known:
            first, last = _bounds(n)
            within = digits.between(first, last)
            found = found | (within if first.startswith(_MAPPED) and last.startswith(_MAPPED) else ~four & within)
        return found

    return F.coalesce(let(address_digits(ip), inside), F.lit(False))


def _prefix(digits: Column, length: Column | int) -> Column:
    """The first bits of an address, as digits: whole ones, then what is left of the next."""
    whole, rest = F.floor(F.lit(length) / 4).cast("int"), F.lit(length).cast("int") % 4
    next_digit = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    size = F.element_at(F.array(*[F.lit(x) for x in (16, 8, 4, 2)]), rest + 1)
    masked = next_digit - next_digit % size
    return F.concat(F.substr(digits, F.lit(1), whole), F.when(rest > 0, F.lower(F.hex(masked))).otherwise(F.lit("")))


def network_keys(cidr: Column) -> tuple[Column, Column]:
    """(bits, prefix) of a network "address/bits" of either family, with bits counted in the form of `address_digits`; null for anything else."""
    address, bits = F.substring_index(cidr, "/", 1), F.substring_index(cidr, "/", -1).try_cast("int")
    most = F.when(address.contains(":"), 128).otherwise(32)
    length = F.when(cidr.contains("/") & bits.between(0, most), bits + 128 - most)
    return length, _prefix(address_digits(address), length)


def in_networks(hosts: DataFrame, networks: DataFrame) -> DataFrame:
    """The distinct ip of `hosts` (ip) that are in any of `networks` (cidr), however many these are.

    Networks are rows by (bits, prefix); an address has one prefix for each number of
    bits that occurs, at most 129, so this is an equality join that spreads over its keys.
    """
    length, prefix = network_keys(F.col("cidr"))
    known = networks.select(length.alias("bits"), prefix.alias("prefix")).where("bits is not null and prefix is not null").distinct()
    lengths = sorted(r[0] for r in known.select("bits").distinct().collect())  # 129 at the most
    address = hosts.select("ip").distinct().select("ip", address_digits(F.col("ip")).alias("digits")).where("digits is not null")
    # An address of the first family is in no network that is wider than the family.
    tries = [F.when(F.lit(n >= 96) | ~F.col("digits").startswith(_MAPPED), F.struct(F.lit(n).alias("bits"), _prefix(F.col("digits"), n).alias("prefix"))) for n in lengths]
    if not tries:
        return address.select("ip").limit(0)
    keyed = address.select("ip", F.explode(F.filter(F.array(*tries), lambda t: t.isNotNull())).alias("t")).select("ip", "t.bits", "t.prefix")
    return keyed.join(known, ["bits", "prefix"], "left_semi").select("ip").distinct()
