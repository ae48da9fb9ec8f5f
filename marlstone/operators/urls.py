"""Guards against requests to private addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import bound

# Hosts that are this machine, and the networks that are not public, as base and prefix length.
BLOCKED_HOSTS = ("localhost", "localhost.localdomain")
BLOCKED = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.168.0.0", 16), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
BENCHMARK = ("198.18.0.0", 15)
BLOCKED_V6 = (("::", 128), ("::1", 128), ("fc00::", 7), ("fe80::", 10), ("ff00::", 8))

V4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"
#: Numbers as the C library reads them in addresses: hexadecimal, octal or decimal.
_NUMBER = r"0[xX][0-9a-fA-F]{1,8}|\d{1,10}"


def _network(network: tuple[str, int]) -> tuple[int, int]:
    base = reduce(lambda n, part: n * 256 + int(part), network[0].split("."), 0)
    return base, base + (1 << (32 - network[1])) - 1


def _value(part: Column) -> Column:
    """A part of an address as a number."""
    digits = F.when(part.rlike("^0[xX]"), F.conv(F.substring(part, 3, 8), 16, 10)).when(part.rlike("^0[0-7]+$"), F.conv(part, 8, 10)).otherwise(part)
    return F.try_to_number(digits, F.lit("9999999999")).cast("long")


def ipv4_number(address: Column) -> Column:
    """The address as a number; null where it is none. Addresses of one to three numbers count as the C library reads them:
    the last number fills the bytes that are left."""

    def whole(parts: Column) -> Column:
        n, last = F.size(parts), F.element_at(parts, -1)
        weights = F.array(*[F.lit(1 << k).cast("long") for k in (24, 16, 8)])
        head = F.slice(parts, F.lit(1), n - 1)
        fits = F.forall(head, lambda x: x <= 255) & (last < F.element_at(F.array(*[F.lit(1 << k).cast("long") for k in (32, 24, 16, 8)]), n))
        total = F.aggregate(F.zip_with(head, F.slice(weights, F.lit(1), n - 1), lambda x, w: x * w), last, lambda a, x: a + x)
        return F.when(F.coalesce(fits, F.lit(False)), total)

    return F.when(address.rlike(rf"^({_NUMBER})(\.({_NUMBER})){{0,3}}$"), bound(F.transform(F.split(address, r"\."), _value), whole))


def ipv6_words(address: Column) -> Column:
    """The eight 16-bit words of an IPv6 address in any of its forms, null where it is none."""
    side = lambda c: F.filter(F.split(c, ":"), lambda x: x != "")

    def plain(low: Column) -> Column:
        # an IPv4 address at the end counts as two words
        tail = F.regexp_extract(low, r":([0-9]+(?:\.[0-9]+){3})$", 1)
        two = bound(ipv4_number(tail), lambda n: F.concat(F.lower(F.hex(F.floor(n / 65536))), F.lit(":"), F.lower(F.hex(n % 65536))))
        return F.when(low.contains("."), F.when(tail.rlike(V4), F.concat(F.regexp_replace(low, r"[0-9.]+$", ""), two))).otherwise(low)

    def words(own: Column) -> Column:
        left, right = side(F.split_part(own, F.lit("::"), F.lit(1))), side(F.split_part(own, F.lit("::"), F.lit(2)))
        short = own.contains("::")
        gap = F.lit(8) - F.size(left) - F.size(right)
        whole = F.concat(left, F.array_repeat(F.lit("0"), F.when(short, F.greatest(gap, F.lit(0))).otherwise(F.lit(0))), right)
        shaped = own.rlike(r"^[0-9a-f:]*:[0-9a-f:]*$") & ~own.rlike(r":::|::.*::|[0-9a-f]{5}") & (short | ~own.rlike("^:|:$")) & (~short | (gap >= 1))
        return F.when(F.coalesce(shaped, F.lit(False)), bound(whole, lambda w: F.when(F.size(w) == 8, F.transform(w, lambda x: F.conv(x, 16, 10).cast("int")))))

    return bound(bound(F.lower(F.regexp_replace(address, r"^\[|\]$|%.*$", "")), plain), words)


def _v6_network(network: tuple[str, int]) -> tuple[list[int], int]:
    import ipaddress

    packed = ipaddress.IPv6Address(network[0]).packed
    return [packed[k] * 256 + packed[k + 1] for k in range(0, 16, 2)], network[1]


def _inside_v6(words: Column, network: tuple[str, int]) -> Column:
    base, bits = _v6_network(network)
    tests = []
    for k in range(8):
        own = min(16, max(0, bits - 16 * k))
        if own:
            tests.append(F.shiftright(F.element_at(words, k + 1), 16 - own) == base[k] >> (16 - own))
    return reduce(lambda a, b: a & b, tests)


def is_ip_literal(host: Column) -> Column:
    """Whether a host is an address itself, in any form that a resolver takes for one."""
    return F.coalesce(ipv4_number(host).isNotNull(), F.lit(False)) | F.coalesce(ipv6_words(host).isNotNull(), F.lit(False))


def is_blocked_address(address: Column, host_is_literal: Column) -> Column:
    """Whether a resolved address is not public; IPv4 addresses inside IPv6 ones count as themselves. The benchmark network
    is let through for host names only."""
    either = lambda tests: F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))
    v4 = lambda n: either([*(n.between(*_network(x)) for x in BLOCKED), n.between(*_network(BENCHMARK)) & host_is_literal])

    def v6(words: Column) -> Column:
        mapped = F.forall(F.slice(words, 1, 5), lambda x: x == 0) & (F.element_at(words, 6) == 65535)
        inner = F.element_at(words, 7).cast("long") * 65536 + F.element_at(words, 8)
        return F.when(words.isNull(), False).when(mapped, bound(inner, v4)).otherwise(either([_inside_v6(words, x) for x in BLOCKED_V6]))

    return bound(ipv4_number(address), v4) | bound(ipv6_words(address), v6)


def url_host(url: Column) -> Column:
    """The host in lower case without brackets."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.lower(F.regexp_replace(authority, r"^\[|\]$", ""))


def url_verdict(url: Column, addresses: Column | None = None) -> Column:
    """`ok`, or why a URL is refused: its `scheme`, its `host`, an `address` it resolves to (an array, where known), or
    `unresolved` where it is a name whose addresses are not known: the guard lets through only what it has seen to be public.
    A null URL is refused for its scheme."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    known = F.array().cast("array<string>") if addresses is None else F.coalesce(addresses, F.array().cast("array<string>"))
    own = F.struct(url_host(url).alias("host"), is_ip_literal(url_host(url)).alias("literal"), known.alias("known"))

    def told(u: Column) -> Column:
        host, literal = u["host"], u["literal"]
        resolved = F.when(literal, F.array(host)).otherwise(u["known"])
        named = (host == "") | F.regexp_replace(host, r"\.$", "").isin(*BLOCKED_HOSTS) | host.endswith(".localhost")
        private = F.exists(resolved, lambda a: is_blocked_address(a, literal))
        return F.when(named, "host").when(private, "address").when(F.size(resolved) == 0, "unresolved").otherwise("ok")

    return F.when(url.isNull() | ~scheme.isin("http", "https"), "scheme").otherwise(bound(own, told))
