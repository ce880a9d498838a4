"""URL filter: longest matching rule, else logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from the small labelled table below (or one given by the
caller; it is bounded by ``max_labelled`` rows). Both the model, of fixed size, and the rules
travel with the task closure. Scoring is one pass without a shuffle.

The table is made by rule: hosts of one to three stems of one kind, joined in several ways, at many
top-level names, with paths of either kind or neutral ones, and hosts of invented syllables, which are
allowed: an unknown name is no fault. ``held_out`` tells how well the model does on hosts with stems
that it has not seen.

Defined results: a null url, or one without ``://``, has an empty host and path and gets the
model's verdict on nothing, which is its intercept; hosts and paths are compared as they are, but for
A-Z in hosts, at any length; of rules of equal length the first in order wins; repeated rows are
judged each; the caller's columns may have any names, they come back as the struct own_row; an empty table
gives an empty table.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lumenframe.llm.common import row_struct, table
from lumenframe.llm.kernels import U64, joined, prefix_hash, window_hash

DIMS = 1 << 14
GRAMS = (3, 4, 5)

# Rules of the query, as verdict and host with path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

# Stems of hosts that a filter of training pages blocks: gambling, adult, drugs, fakes, loans and schemes, spam and traffic, malware and theft.
BAD_STEMS = (
    "casino poker slots roulette blackjack baccarat keno craps betting bets sportsbet jackpot lottery lotto gambling gambler sportsbook bookmaker bingo wager spins highroller"
    " adult porn porno xxx sex sexy escort webcam camgirls nude nudes hentai fetish milf hookup erotic strip"
    " viagra pills cialis steroids xanax tramadol oxycontin weightloss slimming meds cheapmeds hgh potency enlargement"
    " replica replicas counterfeit fakewatch fakeid fakebags knockoff essaywriter essaymill diploma"
    " loan loans payday cashadvance quickcash forex binaryoption getrich freemoney earnmoney easymoney ponzi pyramid airdrop doublecoin cryptoprofit makemoney profit"
    " spam bulkmail massmail linkfarm spamfarm contentfarm clickbait adserver adtrack adclick banner popunder popup trafficexchange backlinks seoboost buyfollowers likes autosurf"
    " warez crack cracked keygen serials torrent nulled phishing phish malware botnet ransomware spyware trojan exploitkit virusalert stealer hacked cheats"
    " prize winner freegift giftcard coupon cheap discount freebies sweepstakes clearance"
).split()
# Stems of hosts that it allows.
GOOD_STEMS = (
    "news weather library museum school university college campus faculty science history geography biology physics chemistry math statistics art music opera theatre cinema books reading poetry travel hotel"
    " garden recipes kitchen cooking bakery health hospital clinic nursing city town village council government ministry parliament court police embassy railway station airport transport bus ferry bridge"
    " sport football tennis chess cycling running swimming climbing family parents children kids nature forest river mountain island coast ocean astronomy space"
    " engineering software docs manual wiki forum community blog journal diary magazine press radio television podcast energy solar water farm agriculture vineyard market store bookshop furniture bank insurance law notary"
    " church temple charity foundation heritage photo film dance language grammar dictionary translation research laboratory institute academy archive gallery festival workshop design architecture pottery knitting woodwork bicycle animal bird"
).split()
# Paths of either kind, and neutral ones.
BAD_PATHS = "/win-now /bonus?code=1 /buy-cheap-online /promo/free /click.php?id=7 /download/crack.exe /join-now /discount/80 /xxx/1 /order-pills".split()
GOOD_PATHS = "/about /article/2020/05/review /docs/guide.html /events/spring /contact /research/paper.pdf /library/catalog /history /weather/today /recipes/soup".split()
PLAIN_PATHS = ["", "/", "/index.html", "/en/12", "/fr/345.html", "/de/7/", "/es/89", "/page?id=3", "/2021/11/04/post", "/a/b/c"]
TOPS = "com org net info example.com example.net co.uk de fr es io eu".split()


def made_hosts(stems: list[str], seed: int, each: int = 10) -> list[str]:
    """For every stem a number of hosts with it, alone or with other stems of its kind."""
    rnd = random.Random(seed)
    extra = ["", "my", "the", "best", "top", "online", "24", "world", "club", "site"]
    out = []
    for w in stems:
        for k in range(each):
            parts = [w] if k < 2 else [w, rnd.choice(stems)] if k < 4 else [rnd.choice(stems), w]
            more = rnd.choice(extra)
            parts = [x for x in ([more, *parts] if rnd.random() < 0.5 else [*parts, more]) if x]
            out.append(rnd.choice(["", "", "www.", "m.", "blog."]) + rnd.choice(["-", "", "-"]).join(parts) + "." + rnd.choice(TOPS))
    return out


def made_names(n: int, seed: int) -> list[str]:
    """Hosts of invented names."""
    rnd = random.Random(seed)
    syllable = lambda: rnd.choice("b c d f g h k l m n p r s t v w th sh ch st tr br".split()) + rnd.choice(["a", "e", "i", "o", "u", "ou", "ea", "io"]) + rnd.choice(["", "", "n", "r", "s", "nd", "t", "l", "ng"])
    return [rnd.choice(["", "www.", "m.", "blog."]) + "".join(syllable() for _ in range(rnd.randrange(2, 5))) + "." + rnd.choice(TOPS) for _ in range(n)]


def labelled_urls(bad: list[str] = BAD_STEMS, good: list[str] = GOOD_STEMS, seed: int = 5) -> list[tuple[str, int]]:
    """(url, 1 for block); neither top-level name, prefix nor neutral path decides."""
    rnd = random.Random(seed)
    out = []
    for label, hosts, own in ((1, made_hosts(bad, seed + 1), BAD_PATHS), (0, made_hosts(good, seed + 2), GOOD_PATHS), (0, made_names(6 * len(good), seed + 3), GOOD_PATHS)):
        out += [(f"{rnd.choice(['http', 'https'])}://{h}{rnd.choice(own if rnd.random() < 0.3 else PLAIN_PATHS)}", label) for h in hosts]
    return out


def held_out(folds: int = 5) -> tuple[float, float]:
    """Shares of right verdicts on hosts of stems that were left out of training, for those to block and those to allow, each with a neutral path."""
    right = [[], []]
    for k in range(folds):
        part = lambda stems, own: [w for i, w in enumerate(stems) if (i % folds == k) == own]  # noqa: E731, B023
        w = train(labelled_urls(part(BAD_STEMS, False), part(GOOD_STEMS, False)))
        for label, stems in ((1, BAD_STEMS), (0, GOOD_STEMS)):
            z = logits([host_path(f"http://{h}/en/1") for h in made_hosts(part(stems, True), 99)], w)
            right[label] += ((z > 0) == bool(label)).tolist()
    return float(np.mean(right[1])), float(np.mean(right[0]))


def host_path(url: str | None) -> tuple[str, str]:
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    cut = min((p for p in map(rest.find, "/?#") if p >= 0), default=len(rest))
    host = rest[:cut].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    path = rest[cut:]
    return host, path[: min((p for p in map(path.find, "?#") if p >= 0), default=len(path))]


def gram_indices(parts: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed dimension of every n-gram; host and path are apart, with marks at the ends of hosts."""
    rows, dims = [], []
    for salt, texts in ((1, [f"^{h}$".encode("utf-8", "surrogatepass") if h else b"" for h, _ in parts]), (2, [p.encode("utf-8", "surrogatepass") for _, p in parts])):
        buf, at = joined(texts)
        prefix, ends = prefix_hash(buf), at[1:] - 1
        for n in GRAMS:
            h = window_hash(prefix, n)
            own = np.searchsorted(at, np.arange(len(h)), side="right") - 1
            ok = np.arange(len(h)) + n <= ends[own] if len(h) else np.empty(0, dtype=bool)
            rows.append(own[ok])
            dims.append(((h[ok] >> U64(8 * salt)) & U64(DIMS - 1)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(dims)


def logits(parts: list[tuple[str, str]], weights: np.ndarray) -> np.ndarray:
    rows, dims = gram_indices(parts)
    n = np.maximum(np.bincount(rows, minlength=len(parts)), 1)
    return np.bincount(rows, weights=weights[dims], minlength=len(parts)) / np.sqrt(n) + weights[DIMS]


def train(labelled: list[tuple[str, int]], steps: int = 400, rate: float = 40.0, decay: float = 2e-5, max_labelled: int = 100_000, block_weight: float = 0.2) -> np.ndarray:
    """Weights, with the intercept last, by full-batch gradient descent from zero, URLs to block with ``block_weight`` of all weight, so that what is unknown is rather allowed: the same table gives the same model."""
    if len(labelled) > max_labelled:
        raise ValueError(f"the labelled table has {len(labelled)} rows; at most {max_labelled} are meant")
    parts = [host_path(u) for u, _ in labelled]
    y = np.array([v for _, v in labelled], dtype=float)
    rows, dims = gram_indices(parts)
    norm = np.sqrt(np.maximum(np.bincount(rows, minlength=len(parts)), 1))
    w = np.zeros(DIMS + 1)
    share = np.where(y == 1, block_weight / max(y.sum(), 1), (1 - block_weight) / max((1 - y).sum(), 1))
    for _ in range(steps):
        z = np.bincount(rows, weights=w[dims], minlength=len(parts)) / norm + w[DIMS]
        g = (1 / (1 + np.exp(-z)) - y) * share
        w[:DIMS] -= rate * (np.bincount(dims, weights=(g / norm)[rows], minlength=DIMS) + decay * w[:DIMS])
        w[DIMS] -= rate * g.sum()
    return w


class RuleBook:
    """The longest rule that fits, found by the suffixes of a host."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        labels = host.split(".") if host else []
        for i in range(len(labels)):
            for start, rule, verdict in self.by_host.get(".".join(labels[i:]), ()):
                if path.startswith(start) and len(rule) > len(best[0] or ""):
                    best = rule, verdict
        return best


def judge_urls(pages: DataFrame, keep: list[str], rules: list[tuple[str, str]], weights: np.ndarray, url: str = "url") -> DataFrame:
    """own_row (the kept columns), host, path, rule, verdict and score (the model's probability of block)."""
    src = pages.select(row_struct(pages, keep), F.col(url).alias("url"))
    schema = StructType([src.schema["own_row"], *(StructField(c, StringType()) for c in ("host", "path", "rule", "verdict")), StructField("score", DoubleType())])

    def run(batches):
        book = RuleBook(rules)
        for b in batches:
            for part in (b.slice(x, 5000) for x in range(0, b.num_rows, 5000)):
                parts = [host_path(u) for u in part.column("url").to_pylist()]
                score = 1 / (1 + np.exp(-logits(parts, weights)))
                found = [book.find(*p) for p in parts]
                verdict = [v or ("block" if s > 0.5 else "allow") for (_, v), s in zip(found, score, strict=True)]
                cols = [pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()), pa.array([r for r, _ in found], pa.string()), pa.array(verdict, pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays([part.column("own_row"), *cols], names=schema.names)

    return src.mapInArrow(run, schema)


def op6_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, ["page_id"], RULES, train(labelled_urls())).select("own_row.page_id", "host", "path", "rule", "verdict")
