"""URL filters: glob rules as one bit-parallel Shift-And automaton.

Every pattern character is one bit of a multiword state; all patterns, packed end to
end, step together on each byte of the canonical URL, and all URLs of a batch step
together. ``*`` matches any run of bytes and ``^`` any run without a slash; both are
self-loops of the state before them.

A null URL, or one without ``://``, has empty host and path, fits no rule that names
a host, and gets the default verdict. Repeated URLs are judged row by row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm._common import table

#: (verdict, host, path): a rule fits its host and all subdomains from that path on.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
DEFAULT = "allow"


def rule_globs(rules: list[tuple[str, str, str]]) -> list[str]:
    """Globs over ``.host/path``: ``^`` spans labels of the host, ``*`` the rest of the path."""
    return [f"^.{host}{path}*" for _, host, path in rules]


class ShiftAnd:
    """All globs at once. Bit i of the state: the first i characters of a pattern are matched."""

    def __init__(self, globs: list[str]):
        step: list[tuple[int, int]] = []  # (bit, byte) that leads to the bit
        loops: list[tuple[int, bool]] = []  # (bit, whether a slash is allowed)
        self.starts, self.ends, at = [], [], 0
        for g in globs:
            self.starts.append(at)
            for c in g.encode():
                if c in b"*^":
                    loops.append((at, c == ord("*")))
                else:
                    at += 1
                    step.append((at, c))
            self.ends.append(at)
            at += 1  # the next pattern's start is a bit of its own
        self.n_words = (at + 63) // 64
        self.step, self.loop = np.zeros((256, self.n_words), np.uint64), np.zeros((256, self.n_words), np.uint64)
        for bit, c in step:
            self.step[c, bit // 64] |= np.uint64(1 << bit % 64)
        for bit, slash in loops:
            ok = np.array([slash or c != ord("/") for c in range(256)])
            self.loop[ok, bit // 64] |= np.uint64(1 << bit % 64)
        self.first = np.zeros(self.n_words, np.uint64)
        for bit in self.starts:
            self.first[bit // 64] |= np.uint64(1 << bit % 64)

    def match(self, urls: list[bytes]) -> np.ndarray:
        """Booleans, URL by pattern: the whole URL fits the glob."""
        n, out = len(urls), np.zeros((len(urls), len(self.ends)), bool)
        if not n:
            return out
        length = np.array([len(u) for u in urls])
        order = np.argsort(-length, kind="stable")
        begins = np.concatenate(([0], np.cumsum(length)))[:-1][order]
        flat, sizes = np.frombuffer(b"".join(urls) + b"\0", np.uint8), length[order]
        state = np.tile(self.first, (n, 1))
        top = np.uint64(63)
        live = n
        for t in range(int(sizes[0])):
            while live and sizes[live - 1] <= t:
                live -= 1
            d, c = state[:live], flat[begins[:live] + t]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> top
            state[:live] = (moved & self.step[c]) | (d & self.loop[c])
        for k, bit in enumerate(self.ends):
            out[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) > 0
        return out


def judge_urls(pages: DataFrame, rules=RULES, default: str = DEFAULT, url_col: str = "url") -> DataFrame:
    """All of ``pages`` plus host, path, rule and verdict, in place of columns so named.

    Of the rules that fit the longest wins; of equally long ones the blocking, then the
    first in order of its text.
    """
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    automaton = ShiftAnd(rule_globs(order))
    names, verdicts = [h + p for _, h, p in order], [v for v, _, _ in order]

    @F.pandas_udf("rule string, verdict string")
    def judge(canonical: pd.Series) -> pd.DataFrame:
        fits = automaton.match([u.encode("utf-8", "surrogatepass") for u in canonical])
        best = np.where(fits.any(1), fits.argmax(1), -1) if fits.size else np.full(len(canonical), -1)
        return pd.DataFrame(
            {"rule": pd.Series([names[k] if k >= 0 else None for k in best], dtype=object), "verdict": pd.Series([verdicts[k] if k >= 0 else default for k in best], dtype=object)}
        )

    u = F.col(url_col)
    after = F.when(F.instr(u, "://") > 0, u.substr(F.instr(u, "://") + 3, F.length(u)))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = pages.withColumn("host", lowered).withColumn("path", path)
    found = found.withColumn("_ps_judged", judge(F.concat(F.lit("."), F.col("host"), F.col("path"))))
    return found.withColumn("rule", F.col("_ps_judged.rule")).withColumn("verdict", F.col("_ps_judged.verdict")).drop("_ps_judged")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS a FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(a, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(a, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fit AS (SELECT page_id, first(rh || rp ORDER BY length(rh || rp) DESC) AS rule, first(verdict ORDER BY length(rh || rp) DESC) AS verdict FROM hp JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT hp.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hp LEFT JOIN fit USING (page_id)
"""
