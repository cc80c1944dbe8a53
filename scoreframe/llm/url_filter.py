"""URL filter: logistic regression on hashed character n-grams of host and path, under explicit rules.

The model is trained here from a small labelled URL table (below; callers may pass their own); tests hold out parts of
it. Rules name a host, with its subdomains, and a path prefix; the longest fitting rule decides, else the model.

Defined cases: a null url or one without "://" has an empty host and path and is judged like any other; empty tables
give no rows; repeated urls get equal verdicts. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: The labelled table: urls as such sites form them, unwanted ones (gambling, pills, adult, fraud, malware, advertising,
#: link spam) and ordinary ones (news, reference, shops, public bodies, blogs, software).
UNWANTED = """
online-casino-bonus.com/slots/free-spins  royalcasino777.net/en/roulette  www.bestcasinos-online.org/no-deposit-bonus  luckyjackpots.example.com/play-now  pokerstars-bonus.info/texas-holdem
megaslots24.biz/fruit-machines  bet365-tips.net/odds/today  sportsbetting-picks.com/free-tips  livebets.example.org/football-odds  bettingexpert-pro.com/bonus-code
bingo-winner.co/lottery/claim-prize  lotto-jackpot-winner.info/claim  vegas-gambling.example.net/blackjack  freeroulette-money.com/win-big  casinoroyal-mobile.com/app
buy-viagra-online.biz/order/cheap  canadian-pharmacy-discount.com/cialis  cheapmeds-noprescription.net/pills  weightloss-pills.example.com/buy-now  steroids-shop.org/anabolic
herbalpills-enlargement.com/order  generic-xanax.info/overnight-delivery  dietpills-miracle.com/offer/50-off  pharma-rx-deals.net/tramadol  viagra-generic-cheap.example.org/checkout
hotxxxvideos.com/free-porn  adultcams-live.net/girls/webcam  sexdating-tonight.com/join-free  nudeteens.example.com/gallery  escort-service-city.org/models
pornhub-mirror.xyz/video/hd  xxxmovies-free.info/watch  milfdating-local.com/signup  livesexcams.example.net/models  camgirls-private.com/show
secure-login-paypal-verify.com/update/account  appleid-verification.info/signin/confirm  bank-account-suspended.net/login.php  verify-your-wallet.xyz/restore  free-gift-card-winner.com/survey
crypto-doubler.io/invest-now  bitcoin-profit-system.com/get-rich  forex-millionaire-secret.net/join  payday-loans-instant.org/apply-fast  work-from-home-cash.biz/earn-money
iphone-winner.example.com/congratulations  fast-cash-advance.com/no-credit-check  nigerian-inheritance.net/claim-funds  miracle-investment.example.org/double-your-money  cheap-loans-today.info/approved
warez-downloads.ru/crack/keygen  serialkeys-free.com/photoshop-crack  torrents-movies-hd.to/download-free  full-version-crack.net/patch  free-antivirus-scan.xyz/setup.exe
malware-host.example.net/payload.exe  driver-updater-pro.com/download/setup.exe  cracked-games.org/torrent/latest  codec-pack-required.info/install.exe  hackedapps.mobi/mod-apk
ads.clicktracker-network.com/redirect  adserver.popunder-media.net/serve  track.affiliate-offers.com/click  banner-exchange.example.com/ad/show  doubleclick-clone.net/adclick
adtracking.example.org/pixel  popads-delivery.com/impression  clickbait-viral.net/you-wont-believe  tracker.adnetwork-cdn.info/track  promo-banners.biz/adframe
seo-backlinks-cheap.com/buy-links  linkfarm-directory.info/submit  guestpost-links.net/order  free-traffic-generator.com/spam  replica-watches-outlet.com/rolex
louisvuitton-replica.biz/cheap-bags  nike-outlet-discount.example.com/sale  comment-spam-tool.net/buy  buyfollowers-cheap.com/instagram  spam-mailer.example.org/bulk
adult-dating-club.com/members  adultmovies-online.net/stream  adult-toys-shop.example.com/sale  adultchat.example.org/rooms  www.adult-entertainment-guide.info/clubs
spamblaster-pro.com/bulk-mailer  forum-spam-service.net/order  spam-network.example.com/gateway  blogspam.example.net/links  www.spam-software-cheap.biz/download
""".split()
ORDINARY = """
www.city-gazette.com/news/2023/05/council-votes-on-budget  www.daily-herald.example.com/politics/election-results  morningpost.net/world/europe/summit  thetribune.org/opinion/letters  evening-standard.example.org/sport/rugby
newsroom.university.edu/research/new-telescope  www.weatherservice.gov/forecast/north  regional-times.com/business/markets  radio-one.org/programmes/history  journal-of-physics.org/articles/volume-12
en.encyclopedia.org/wiki/Photosynthesis  de.lexikon.org/wiki/Geschichte  fr.encyclopedie.example.org/wiki/Montagne  dictionary.example.com/definition/harbour  openlibrary.org/works/ocean-stories
archive.museum.example.org/collections/maps  www.nationalgallery.org/exhibitions  botanic-garden.org/visit/opening-hours  theatre-royal.co.uk/whats-on  cityopera.example.com/season
www.st-marys-school.org/parents/term-dates  college.edu/admissions/apply  www.statistics-office.gov/population/2021  parliament.example.org/bills/second-reading  courts.gov/judgments/2020
council.gov.uk/planning/applications  hospital-trust.nhs.example.org/services/cardiology  www.fire-service.org/safety  health.example.com/conditions/asthma  kinderarzt-praxis.de/sprechzeiten
docs.python-guide.org/tutorial/functions  developer.framework.dev/reference/api  github-pages.example.com/project/readme  linux-howto.org/kernel/modules  blog.database.dev/query-planning
packages.distribution.org/stable/editors  wiki.compiler.org/optimizations  support.software.example.com/kb/installing  forum.programmers.example.org/thread/4211  status.cloudprovider.example.net/history
www.mountain-railway.ch/timetable  travel.example.com/guides/lisbon  hotel-seeblick.de/zimmer  camping-normandie.fr/tarifs  islandferries.com/routes
walking-paths.example.org/lake-district  airport.example.net/arrivals  bicycle-tours.org/routes/river  castle-museum.org/tickets  wanderlust-journal.com/patagonia
recipes.kitchen.example.com/bread/sourdough  gardening-club.org/roses/pruning  www.bakery-on-the-corner.com/menu  woodworking.example.com/joints/dovetail  knitting-patterns.org/socks
birdwatching.example.org/species/heron  astronomy-society.org/meetings  chess-club.example.com/results  local-history.org/mills  photo-blog.example.net/autumn
bookshop.example.com/fiction/new  furniture-store.com/tables/oak  hardware.example.net/tools/saws  toys-and-games.co.uk/puzzles  shoes.example.org/walking-boots
music-school.org/lessons/violin  orchestra.example.com/concerts  film-institute.org/festival/programme  football-association.com/fixtures  athletics.example.org/records
bank.example.com/branches/opening-times  insurance-advice.org/home  taxes.gov/forms/self-assessment  pension-service.gov/contact  energy.example.net/tariffs/explained
charity.example.org/donate/blankets  church-of-st-john.org/services  rotary-club.org/events  volunteers.example.com/join  food-bank.org/locations
personal-site.net/about  my-notebook.example.com/2019/03/first-post  family-tree.example.org/miller  poems.example.net/winter  thoughts.example.com/essays/on-reading
vogelschutz.de/arten/storch  gemeinde-neustadt.de/rathaus  boulangerie.fr/pains  mairie-lyon.fr/services  biblioteca.es/horario
periodico.es/cultura/teatro  universidad.es/facultades/ciencias  ayuntamiento.es/agenda  museo.es/coleccion/pintura  zeitung.de/politik/wahl
""".split()


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 if unwanted) of the labelled table."""
    rows = []
    for label, urls in ((1, UNWANTED), (0, ORDINARY)):
        for url in urls:
            host, _, path = url.partition("/")
            rows += [(host, f"/{path}", label), (host.removeprefix("www."), "/", label)]
    return rows


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host's A-Z are lower-cased; both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, prefix = text.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{prefix}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def grams(host: str, path: str, bits: int = 16, sizes: tuple[int, ...] = (3, 4, 5)) -> list[int]:
    """Hashed n-grams of host and path, each marked by its part."""
    found = set()
    for mark, part in (("h", f"^{host}$"), ("p", f"^{path.lower()}$")):
        for n in sizes:
            for i in range(max(1, len(part) - n + 1)):
                found.add(zlib.crc32(f"{mark}{part[i : i + n]}".encode("utf-8", "surrogatepass")) & ((1 << bits) - 1))
    return sorted(found)


def train(rows: list[tuple[str, str, int]], bits: int = 16, steps: int = 400, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias; plain gradient descent with momentum on the logistic loss (a few hundred rows)."""
    feats = [grams(h, p, bits) for h, p, _ in rows]
    y = np.array([r[2] for r in rows], float)
    row = np.repeat(np.arange(len(rows)), [len(f) for f in feats])
    col = np.concatenate([np.array(f) for f in feats]) if rows else np.zeros(0, int)
    scale = 1 / np.sqrt(np.bincount(row, minlength=len(rows)).clip(1))
    w, b, v, vb = np.zeros(1 << bits), 0.0, np.zeros(1 << bits), 0.0
    for _ in range(steps):
        z = np.bincount(row, w[col], minlength=len(rows)) * scale + b
        d = 1 / (1 + np.exp(-z)) - y
        g = np.bincount(col, (d * scale)[row], minlength=1 << bits) / max(1, len(rows)) + penalty * w
        v, vb = 0.9 * v - 5.0 * g, 0.9 * vb - 5.0 * d.mean()
        w, b = w + v, b + vb
    return w, float(b)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rows: list[tuple[str, str, int]] | None = None, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row."""
    weights, bias = train(labelled_urls() if rows is None else rows)
    w, b = weights.astype(np.float32), bias

    @F.pandas_udf("double")
    def unwanted(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in parts:
            out = []
            for h, p in zip(hosts, paths, strict=True):
                f = grams(h, p)
                out.append(1 / (1 + np.exp(-(w[f].sum(dtype=float) / np.sqrt(len(f)) + b))))
            yield pd.Series(out, dtype=float)

    host, path = split_url(F.col(url_col))
    base = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = base.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("_ruled"), unwanted("host", "path").alias("score"))
    by_model = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(id_col, "host", "path", "rule", F.coalesce("_ruled", by_model).alias("verdict"), "score")
