"""Which social network a link belongs to."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwright.config import SOCIAL_NETWORKS, SOCIAL_URL_LIMIT
from listwright.functions.text import distinct_values, let, url_host

# Per network the hosts, the words that rule a link out and the
# paths of which one is needed. The first network that fits takes the link.
RULES = {
    "facebook": {"hosts": ["facebook.com"], "without": ["sharer", "share"], "paths": []},
    "instagram": {"hosts": ["instagram.com"], "without": ["share", "stories"], "paths": []},
    "linkedin": {
        "hosts": ["linkedin.com"],
        "without": ["share", "sharing"],
        "paths": ["/in/", "/company/"],
    },
    "x": {"hosts": ["x.com", "twitter.com"], "without": ["share", "intent"], "paths": []},
}


def _any(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


def is_network(link: Column, network: str, strict_host: bool = False) -> Column:
    """Does the link fit the rules of one network, taken alone?"""
    rule = RULES[network]
    if strict_host:
        host = url_host(link)
        on_host = _any([(host == h) | host.endswith("." + h) for h in rule["hosts"]])
    else:
        on_host = _any([F.contains(link, F.lit(h + "/")) for h in rule["hosts"]])
    tests = [on_host, F.length(link) < SOCIAL_URL_LIMIT]
    tests += [~F.contains(link, F.lit(word)) for word in rule["without"]]
    if rule["paths"]:
        tests.append(_any([F.contains(link, F.lit(p)) for p in rule["paths"]]))
    return F.coalesce(reduce(and_, tests), F.lit(False))


def social_class(link: Column, strict_host: bool = False) -> Column:
    """Name of the first network that fits, NULL for other links."""
    name = None
    for network in SOCIAL_NETWORKS:
        fits = is_network(link, network, strict_host)
        name = F.when(fits, network) if name is None else name.when(fits, network)
    return name


def may_hold_social(html: Column) -> Column:
    """Cheap test that is true for every text in which a social link can occur."""
    hosts = [h for rule in RULES.values() for h in rule["hosts"]]
    return _any([F.contains(html, F.lit(h + "/")) for h in hosts])


def classify_social(links: Column, strict_host: bool = False) -> Column:
    """Struct with one sorted, distinct list of links per network."""
    tagged = F.transform(
        links, lambda u: F.struct(social_class(u, strict_host).alias("network"), u.alias("link"))
    )

    def per_network(pairs: Column) -> Column:
        def links_of(network: str) -> Column:
            matching = F.filter(pairs, lambda t: t["network"] == network)
            return distinct_values(F.transform(matching, lambda t: t["link"])).alias(network)

        return F.struct(*[links_of(n) for n in SOCIAL_NETWORKS])

    return let(F.filter(tagged, lambda t: t["network"].isNotNull()), per_network)
