"""Counters and latency histograms, and their text form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the latency buckets in seconds.
BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def labelled_counts(events: DataFrame, label: str) -> DataFrame:
    """(label, n): a counter with one label; null is a label of its own."""
    return events.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def latency_histogram(events: DataFrame, value: str, bounds: list[float] | None = None) -> DataFrame:
    """(le, n): cumulative buckets with +Inf, and the rows `sum` and `count`; one pass, no shuffle of rows."""
    bounds = BUCKETS if bounds is None else bounds
    x = F.col(value)
    aggs = [F.count_if(x <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    one = events.where(x.isNotNull()).agg(*aggs, F.count(F.lit(1)).alias("c"), F.coalesce(F.sum(x), F.lit(0.0)).alias("s"))
    rows = [F.struct(F.lit(_bound(b)).alias("le"), F.col(f"b{i}").cast("double").alias("n")) for i, b in enumerate(bounds)]
    rows += [F.struct(F.lit(n).alias("le"), F.col(c).cast("double").alias("n")) for n, c in (("+Inf", "c"), ("sum", "s"), ("count", "c"))]
    return one.select(F.inline(F.array(*rows)))


def _bound(b: float) -> str:
    return f"{b:g}"


def exposition(name: str, help_text: str, kind: str, rows: list[tuple[dict[str, str], float]]) -> str:
    """A metric in the text format that scrapers read."""

    def quote(v: str) -> str:
        return v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")

    def line(labels: dict[str, str], value: float) -> str:
        inner = ",".join(f'{k}="{quote(v)}"' for k, v in labels.items())
        return f"{name}{'{' + inner + '}' if inner else ''} {value:g}"

    return "\n".join([f"# HELP {name} {help_text}", f"# TYPE {name} {kind}", *(line(a, b) for a, b in rows)]) + "\n"


class Registry:
    """The services' counters: crawled documents, crawl errors, index updates, requests and latencies."""

    def __init__(self) -> None:
        self.crawled = self.crawl_errors = self.index_updates = 0
        self.requests: dict[str, int] = {}
        self.latencies: list[int] = [0] * (len(BUCKETS) + 1)
        self.latency_sum = 0.0

    def observe_request(self, status: str, seconds: float) -> None:
        self.requests[status] = self.requests.get(status, 0) + 1
        self.latency_sum += seconds
        for i, b in enumerate([*BUCKETS, float("inf")]):
            self.latencies[i] += seconds <= b

    def render(self) -> str:
        out = [
            exposition("crawler_documents_total", "Documents crawled.", "counter", [({}, self.crawled)]),
            exposition("crawler_errors_total", "Errors of crawling.", "counter", [({}, self.crawl_errors)]),
            exposition("index_updates_total", "Documents put into the index.", "counter", [({}, self.index_updates)]),
            exposition("search_requests_total", "Search requests.", "counter", [({"status": s}, n) for s, n in sorted(self.requests.items())]),
        ]
        rows = [({"le": _bound(b)}, n) for b, n in zip(BUCKETS, self.latencies)] + [({"le": "+Inf"}, self.latencies[-1])]
        text = exposition("search_latency_seconds_bucket", "Latency of search requests.", "histogram", rows)
        text = text.replace("HELP search_latency_seconds_bucket", "HELP search_latency_seconds").replace("TYPE search_latency_seconds_bucket", "TYPE search_latency_seconds")
        tail = f"search_latency_seconds_sum {self.latency_sum:g}\nsearch_latency_seconds_count {self.latencies[-1]}\n"
        return "".join(out) + text + tail
