"""Enrichment of events as they come in: country and autonomous system of addresses by the longest network that holds
them, and indicators of compromise by value.

An address and a network are 128 bits, in two longs; IPv4 lies in ::ffff:0:0/96, so that both kinds meet in one table. A
network is its length and its masked bits. An address can only lie in networks of the lengths that the table has, at
most 129: it is masked to each of them and met by equality, and the longest match stays. So nothing is compared by
ranges, and addresses of any number of nested networks cost as many rows as there are lengths. Distinct addresses are
looked up once each, and their facts joined to the events; an address of any share of the events is joined where its
events lie.

A text that is no address, or null, gets nulls, as does an address in no network. Of several rows of a network the
newest counts, and none if that is marked as deleted; rows that are no network are left out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions import ip
from rivulet.operators.hot import join_facts
from rivulet.operators.rows import q

#: What a network tells of an address.
FACTS = ("country", "country_code", "continent", "continent_code", "asn", "as_name", "as_domain")
#: What an indicator tells of a value.
THREAT = ("threat_type", "malware", "confidence")
#: Networks of at most so many rows are sent to all tasks.
SMALL = 200_000
_V4 = 0xFFFF << 32


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _half(digits: Column, at: int) -> Column:
    return F.conv(F.substring(digits, at, 16), 16, -10).try_cast("long")


def bits(address: Column) -> tuple[Column, Column]:
    """The upper and lower 64 bits of an address; null for other text."""
    v4, v6 = ip.to_long(address), ip.full_v6(address)
    return F.when(v4.isNotNull(), F.lit(0).cast("long")).otherwise(_half(v6, 1)), F.when(v4.isNotNull(), v4 + F.lit(_V4)).otherwise(_half(v6, 17))


def masks(length: int) -> tuple[int, int]:
    """The upper and lower 64 bits of a mask of so many bits."""
    whole = (1 << 128) - (1 << 128 - length)
    return _signed(whole >> 64), _signed(whole & (1 << 64) - 1)


def network_table(df: DataFrame, facts: tuple[str, ...] = FACTS, network: str = "network", updated: str | None = None, deleted: str | None = None) -> DataFrame:
    """length, hi, lo and fact (a struct of facts) of each network of df, which holds it as text: an address and a
    length, or an address alone. Host bits are masked off. updated: a column that orders rows of one network; ties: the
    greatest by the facts."""
    parts = F.split(F.trim(q(network).cast("string")), "/")
    address, given = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    v4 = ip.to_long(address).isNotNull() & ~address.contains(":")
    most = F.when(v4, 32).otherwise(128)
    length = F.when(given.isNull(), most).when(given.rlike("^[0-9]{1,3}$"), given.try_cast("int"))
    length = F.when((F.size(parts) <= 2) & (length <= most), F.when(v4, length + 96).otherwise(length))
    hi, lo = bits(address)
    both = F.array(*[F.struct(F.lit(m[0]).alias("hi"), F.lit(m[1]).alias("lo")) for m in map(masks, range(129))])
    mask = F.get(both, F.col("length"))
    order = F.struct(q(updated) if updated else F.lit(0), F.struct(*[q(c) for c in facts]))
    gone = q(deleted).cast("boolean") if deleted else F.lit(False)
    rows = df.select(length.alias("length"), hi.alias("h"), lo.alias("l"), F.struct(*[q(c).alias(c) for c in facts]).alias("fact"), order.alias("o"), F.coalesce(gone, F.lit(False)).alias("gone"))
    rows = rows.filter("length IS NOT NULL AND h IS NOT NULL AND l IS NOT NULL")
    keyed = rows.select("length", F.col("h").bitwiseAND(mask["hi"]).alias("hi"), F.col("l").bitwiseAND(mask["lo"]).alias("lo"), "fact", "gone", "o")
    last = keyed.groupBy("length", "hi", "lo").agg(F.max_by(F.struct("fact", "gone"), F.struct("o", ~F.col("gone"))).alias("x"))
    return last.filter("NOT x.gone").select("length", "hi", "lo", "x.fact")


def longest(addresses: DataFrame, networks: DataFrame, lengths: list[int], small: bool = False) -> DataFrame:
    """hi, lo of the distinct addresses that lie in a network, with length and fact of the longest. lengths: those of
    networks."""
    if not lengths:
        return networks.select("hi", "lo", "length", "fact").limit(0)
    steps = F.array(*[F.struct(F.lit(n).alias("length"), F.lit(masks(n)[0]).alias("mh"), F.lit(masks(n)[1]).alias("ml")) for n in lengths])
    each = addresses.select("hi", "lo", F.explode(steps).alias("s"))
    each = each.select(F.col("hi").alias("ah"), F.col("lo").alias("al"), "s.length", F.col("hi").bitwiseAND(F.col("s.mh")).alias("hi"), F.col("lo").bitwiseAND(F.col("s.ml")).alias("lo"))
    met = join_facts(each, networks, ["length", "hi", "lo"], small).filter("fact IS NOT NULL")
    best = met.groupBy("ah", "al").agg(F.max_by(F.struct("length", "fact"), "length").alias("x"))
    return best.select(F.col("ah").alias("hi"), F.col("al").alias("lo"), "x.length", "x.fact")


def indicator_table(df: DataFrame, value: str = "indicator", updated: str | None = None, deleted: str | None = None) -> DataFrame:
    """value (lower case) and threat of each indicator: the newest row, or the most confident where none is newer."""
    order = F.struct(q(updated) if updated else F.lit(0), q("confidence"), q("threat_type"), q("malware"))
    gone = F.coalesce(q(deleted).cast("boolean"), F.lit(False)) if deleted else F.lit(False)
    threat = F.struct(*[q(c).alias(c) for c in THREAT])
    rows = df.select(F.lower(F.trim(q(value).cast("string"))).alias("value"), threat.alias("threat"), gone.alias("gone"), order.alias("o")).filter("value <> ''")
    last = rows.groupBy("value").agg(F.max_by(F.struct("threat", "gone"), F.struct("o", ~F.col("gone"))).alias("x"))
    return last.filter("NOT x.gone").select("value", "x.threat")


@dataclass
class Enricher:
    """What events get as they come in. networks: of network_table(); indicators: of indicator_table(). addresses: field
    to the name in its columns: enriched_<name>_<fact>. artifacts: field to the name in ioc_<name>_<fact>.

    Sizes and lengths are looked up once, for all batches; make another for newer tables."""

    networks: DataFrame | None = None
    indicators: DataFrame | None = None
    addresses: dict[str, str] = field(default_factory=lambda: {"src_ip": "src", "dest_ip": "dest"})
    artifacts: dict[str, str] = field(default_factory=lambda: {"src_ip": "src_ip", "dest_ip": "dest_ip", "domain": "domain", "file_hash": "hash"})
    facts: tuple[str, ...] = FACTS

    def __post_init__(self):
        self._known: dict = {}

    def _look(self, name: str, make):
        if name not in self._known:
            self._known[name] = make()
        return self._known[name]

    def _small(self, name: str) -> bool:
        return self._look(f"small {name}", lambda: getattr(self, name).limit(SMALL + 1).count() <= SMALL)

    def located(self, df: DataFrame, column: str, name: str, source: DataFrame) -> DataFrame:
        hi, lo = bits(q(column).cast("string"))
        lengths = self._look("lengths", lambda: sorted(r[0] for r in self.networks.select("length").distinct().collect()))
        keys = ["__hi", "__lo"]
        addresses = source.select(hi.alias("hi"), lo.alias("lo")).filter("hi IS NOT NULL AND lo IS NOT NULL")
        distinct = addresses.groupBy("hi", "lo").agg(F.lit(1).alias("_")).select("hi", "lo")
        found = longest(distinct, self.networks, lengths, self._small("networks")).select(F.col("hi").alias("__hi"), F.col("lo").alias("__lo"), F.col("fact").alias("__fact"))
        met = join_facts(df.withColumns(dict(zip(keys, (hi, lo)))), found, keys, source=addresses.toDF(*keys))
        return met.select(*[q(c) for c in df.columns], *[F.col(f"__fact.{f}").alias(f"enriched_{name}_{f}") for f in self.facts])

    def enrich(self, df: DataFrame) -> DataFrame:
        """df with the columns of those fields that it has; a column of such a name that it brings along is replaced. What is
        looked up is taken from df itself, so that df is read a few times for each field, whatever their number."""
        out = df
        if self.networks is not None:
            for column, name in self.addresses.items():
                if column in df.columns:
                    out = out.drop(*[f"enriched_{name}_{f}" for f in self.facts])
                    out = self.located(out, column, name, df)
        if self.indicators is None:
            return out
        met = []
        for column, name in self.artifacts.items():
            if column in df.columns:
                value = F.lower(F.trim(q(column).cast("string"))).alias("__value")
                out = out.drop(*[f"ioc_{name}_{f}" for f in THREAT]).withColumn("__value", value)
                facts = self.indicators.toDF("__value", f"__threat_{name}")
                out = join_facts(out, facts, ["__value"], self._small("indicators"), df.select(value)).drop("__value")
                met.append(f"__threat_{name}")
        columns = {f"ioc_{m.removeprefix('__threat_')}_{f}": F.col(f"{m}.{f}") for m in met for f in THREAT}
        columns["ioc_matched"] = F.coalesce(*[F.when(F.col(m).isNotNull(), True) for m in met], F.lit(False))
        columns["ioc_confidence"] = F.greatest(*[F.col(f"{m}.confidence") for m in met], F.lit(None), F.lit(None))
        return out.withColumns(columns).drop(*met)
