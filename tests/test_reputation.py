import ipaddress
import random

import pytest

from logvigil.operators import reputation

ODD = ["", "1.2.3", "256.1.1.1", ":::", "1::2::3", "12345::", "g::1", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::1.2.3", "::1.2.3.256", "1:2:3:4:5:6:7::8:", ":1", "1:"]


def parsed(ip):
    try:
        found = ipaddress.ip_address(ip)
    except ValueError:
        return None
    bits = int(found) << 96 if found.version == 4 else int(found)
    halves = [(h - (1 << 64) if h >> 63 else h) for h in (bits >> 64, bits & (1 << 64) - 1)]
    return (found.version, *halves)


def random_ips(n, seed):
    draw = random.Random(seed)
    for _ in range(n):
        if draw.random() < 0.4:
            yield str(ipaddress.IPv4Address(draw.choice([10 << 24, 192 << 24]) + draw.randrange(1 << draw.choice([4, 12, 24]))))
            continue
        base = draw.choice([0x20010DB8 << 96, 0, 0xFE80 << 112])
        number = ipaddress.IPv6Address(base + draw.randrange(1 << draw.choice([4, 40, 64, 90])))
        yield draw.choice([number.compressed, number.exploded, number.compressed.upper(), f"::ffff:{ipaddress.IPv4Address(draw.randrange(1 << 32))}"])


def test_addresses_are_read_like_the_standard_library_does(spark):
    ips = [*random_ips(500, 1), *ODD, "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "1::3:4:5:6:7:8"]
    rows = spark.createDataFrame([(ip,) for ip in ips], "ip string")
    got = {r.ip: r.a and tuple(r.a) for r in rows.selectExpr("ip", f"{reputation.address('ip')} AS a").collect()}
    assert got == {ip: parsed(ip) for ip in ips}


@pytest.mark.parametrize("longest", [False, True])
def test_ranges_against_the_standard_library(spark, entries_of, longest):
    draw = random.Random(2)
    ips = list(random_ips(150, 3))
    ranges = []
    for ip in random_ips(60, 4):
        version = ipaddress.ip_address(ip).version
        ranges.append((f"{ip}/{draw.randrange(0, 33 if version == 4 else 129)}", f"l{draw.randrange(3)}"))
    ranges += [("10.0.0.0/8", "a"), ("10.0.0.0/8", "b"), ("2001:db8::/32", "a"), ("::/0", "six"), (ips[0], "one")]
    bad = [("10.0.0.0/33", "x"), ("::/129", "x"), ("no/8", "x"), ("1.2.3.4/8/8", "x"), ("1.2.3.4/", "x"), (None, "x")]
    table = spark.createDataFrame(ranges + bad, "cidr string, label string")
    want = set()
    for ip in set(ips):
        hits = [
            (ipaddress.ip_network(c, strict=False).prefixlen, c, label) for c, label in set(ranges)
            if ipaddress.ip_address(ip) in ipaddress.ip_network(c, strict=False)
        ]
        most = max((p for p, *_ in hits), default=0)
        want |= {(ip, c, label) for p, c, label in hits if not longest or p == most}
    got = reputation.ip_reputation(entries_of([{"source_ip": ip} for ip in [*ips, *ODD, None]]), table, longest)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sorted(r.cidr or "" for r in reputation.bad_ranges(table).collect()) == sorted(c or "" for c, _ in bad)
