"""URL filter: host and path rules, then logistic regression on hashed character n-grams. SQL functions only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.llm.common import ascii_lower

WIDTH = 1 << 14
ORDERS = (2, 3, 4, 5)
STEPS, RATE, PENALTY = 500, 6.0, 1e-5
MOST_LABELS = 5000
MOST_RULES = 1000

#: The rules of the default policy.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: The labelled table, by hand: sites to block (adult, gambling, pills, pirated software, fraud, advertising, link farms) and plain
#: ones that look much like them (public bodies, schools, news, shops, forums, reference works, software, local clubs).
BLOCK = """
www.hotpornvideos.tv/watch/milf-compilation xxxclips.club/amateur/page3 freesexcams.live/rooms/couples nudegallery.pics/set/118 adultfriendmeet.com/signup
teen-xxx-tube.biz/new escortsguide.city/london/blonde camgirlz.cam/show/lola69 bigtitsarchive.net/updates hentaiporn.moe/read/ch-12 eroticstories.ws/taboo/17
sexdating4u.info/profiles pornhubmirror.xyz/video/90211 adult-toys-outlet.shop/vibrators milfhookups.date/join nakedcelebs.top/leaks xxxmovies.vip/hd/full freeporn.li/en/latest xxx-porno.mobi/en/clips sexporn-tube.cz/amateur pokerstarsroom.eu/tables torrents.unblocked.li/series sex-chat.rooms.ws/live
luckystarcasino.com/bonus onlinecasinos.bet/slots/mega-jackpot pokerroyal.win/freeroll sportsbetting365.net/odds/nba slotmachines.games/spin betnow88.asia/live
jackpotcity-slots.co/register freespins-casino.info/no-deposit roulettewheel.casino/vip bettingtips.click/today lottoresults-winner.biz/claim bingobonus.uk.com/play
casinoreviews.top/best-10 888poker-download.ru/setup bet-winner.africa/promo slots-online.site/free
cheapviagra.pharmacy/order-now canadianpills.ru/cialis-20mg no-prescription-meds.biz/tramadol buyxanaxonline.cc/overnight weightlosspills.diet/keto-trial genericpharma.su/levitra
steroids-shop.to/anabolic pillstore24.com/checkout?drug=cialis
crackedsoftware.ws/photoshop-keygen torrentmoviez.to/download/1080p warezforum.cc/serials keygenz.org/win11-activator freemoviestream.sx/watch-online getcracked.pro/idm-patch
megatorrents.se/top100 nulledscripts.xyz/themes activationkeys.space/office pirate-downloads.me/games/repack serialkeys.su/antivirus crackzone.biz/full-version
paypal-account-verify.secure-login.tk/update appleid-locked.info/signin bank-of-america.account-alert.ga/confirm free-giftcards.win/amazon claim-your-prize.click/iphone
you-are-a-winner.xyz/lucky-visitor cryptodoubler.io/send-btc fastpaydayloans.us.com/apply-now bad-credit-loans.today/approved make-money-fast.biz/from-home
miracle-cure.top/doctors-hate replica-watches.cn/rolex fakediplomas.org/buy-degree malware-cleaner.download/scan.exe phishingkit.shop/panel scam-wallet.finance/airdrop
adserver.clicktrack.net/banner?id=77 ads.popunder.media/serve.js track.affiliatehub.co/c/9912 pixel.adtracker.io/imp bannerads.exchange/rotate pop-ups.advertnet.ru/show
seo-backlinks.pro/buy-links linkfarm-directory.info/add-url spamblast.email/lists bulkspam-mailer.ru/smtp article-spinner.top/auto auto-blog-spam.xyz/post/4411
clickbait-central.buzz/you-wont-believe cheapfollowers.club/instagram expireddomains-seo.biz/parked doorwaypages.spam.ws/keywords
""".split()
ALLOW = """
en.wikipedia.org/wiki/Photosynthesis github.com/apache/spark/blob/master/README.md stackoverflow.com/questions/11227809/why-is-processing-a-sorted-array arxiv.org/abs/1706.03762
docs.python.org/3/library/itertools.html duckdb.org/docs/sql/introduction developer.mozilla.org/en-US/docs/Web/HTTP www.bbc.co.uk/news/science-environment
www.nytimes.com/2021/03/04/science/mars-rover.html www.lemonde.fr/planete/article/2020/11/03/climat www.spiegel.de/wissenschaft/natur elpais.com/cultura/2019-05-12/musica.html
www.nasa.gov/missions/hubble www.who.int/news-room/fact-sheets/detail/malaria www.gov.uk/apply-driving-licence europa.eu/youreurope/citizens www.loc.gov/collections/maps
mit.edu/courses/linear-algebra www.stanford.edu/research cs.cornell.edu/people/faculty ocw.tudelft.nl/statistics www.uni-heidelberg.de/studium/physik www.sorbonne-universite.fr/recherche
springfield-library.org/events/storytime city.portland.or.us/parks/permits lincolnhighschool.k12.mn.us/band/concerts www.oxfordmuseum.org.uk/exhibits/dinosaurs countyrecords.state.tx.us/search
www.kew.org/plants/orchids birdwatching.org.au/species/kookaburra www.recipetineats.example-kitchen.com/lemon-chicken seriousbaking.com/sourdough-starter gardeningknowhow.net/tomatoes/blight
www.weather.gov/forecast/denver marinetides.info/cornwall/april astronomyclub.ca/meetings knittingpatterns.org/free/cardigan woodworkersjournal.net/projects/bench
hikingtrails.nz/south-island/routeburn trainspotters.co.uk/forum/thread/5521 chessopenings.net/sicilian/najdorf bicyclerepair.help/derailleur sailingmagazine.com/boats/review
www.imdb.com/title/tt0111161 www.goodreads.com/book/show/5107 openstreetmap.org/relation/62149 archive.org/details/gutenberg www.gutenberg.org/ebooks/1342 musicbrainz.org/artist/42a8f507
news.ycombinator.com/item?id=8863 www.reddit.com/r/AskHistorians/comments/9x81 medium.com/@jane/writing-tests-first blog.rust-lang.org/2018/12/06/Rust-1.31 kernel.org/doc/html/latest
pypi.org/project/requests npmjs.com/package/express hub.docker.com/_/postgres wiki.archlinux.org/title/Installation_guide postgresql.org/docs/current/indexes.html
www.mayoclinic.org/diseases/asthma kidshealth.org/en/parents/fever.html www.heart.org/en/healthy-living dentalcare-clinic.com/appointments drsmithpediatrics.com/office-hours
www.ikea.com/se/sv/cat/soffor shop.bookstore.com/fiction/new cornerbakery.biz/menu smithandsonsplumbing.com/services riverside-hotel.at/zimmer flowers-by-anna.com/wedding
fcbarcelona.es/futbol/plantilla www.nba.com/stats/players runnersclub.org/marathon/training cricketarchive.com/scorecards/1983 localcouncil.gov.ie/planning/applications
journal.pone.org/article/10.1371 www.nature.com/articles/s41586-020-2649-2 scholar.archive.edu/thesis/1994/lee physics.info/thermodynamics mathworld.net/Eigenvalue
historyofrome.blog/caesar/gallic-war medievalmanuscripts.ac.uk/psalter genealogyforum.org/surname/baker oldphotographs.city-archive.nl/1920 folkmusic.ie/reels/session
jobs.engineering-weekly.com/berlin realestate.homes.ca/toronto/condo traveljournal.me/patagonia/day-9 cookingwithgrandma.tv/episode/22 moneyadvice.org.uk/mortgages/first-home
kindergarten-sonnenschein.de/anmeldung freiwillige-feuerwehr.at/einsatz mairie-saint-denis.fr/horaires biblioteca.municipal.es/catalogo ayuntamiento.sevilla.org/tramites
dailyherald.com/sports/football/recap mountainradio.fm/playlist worldcinema.review/kurosawa teachersnet.org/lesson-plans/fractions opendata.city.gov/datasets/bus-stops
northstreet-bikes.co.nz/repairs theaterguide.com/matinee scienceforkids.org/volcano gamedesignwiki.net/level-design languageexchange.org/spanish/partners sussex-county.gov/tax
""".split()


#: Endings under which each site is labelled besides its own, so that an ending says nothing.
ENDINGS = ("com", "net", "org")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, label; 1: block): every site of the table as it stands, and its name under common endings, without a path."""
    rows = []
    for label, sites in ((1, BLOCK), (0, ALLOW)):
        for i, site in enumerate(sites):
            rows.append((f"https://{site}", label))
            name = site.partition("/")[0].removeprefix("www.").rpartition(".")[0]
            rows += [(f"http://{('', 'm.', 'www.', 'blog.')[(i + k) % 4]}{name}.{end}/", label) for k, end in enumerate(ENDINGS)]
    return rows


def labelled(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, label) of labelled_urls()."""
    values = ", ".join(f"('{u}', {y})" for u, y in labelled_urls())
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct<verdict, rule>, or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def with_grams(df: DataFrame, host: Column, path: Column, name: str) -> DataFrame:
    """Adds the distinct hashed character n-grams of host and of path, each marked with where it is from.

    The characters are columns of their own, so that they are split once a row and not once an n-gram.
    """

    def at(chars: str, n: int, mark: int):
        return lambda i: F.pmod(F.hash(F.concat(*[F.get(chars, i + k) for k in range(n)]), F.lit(mark)), F.lit(WIDTH)).cast("int")

    parts = []
    for mark, (chars, of) in enumerate((("_host_chars", host), ("_path_chars", path)), 1):
        df = df.withColumn(chars, F.split(F.concat(F.lit("^"), of, F.lit("$")), ""))
        for n in ORDERS:
            starts = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(starts, at(chars, n, mark)))
    return df.withColumn(name, F.array_distinct(F.concat(*parts))).drop("_host_chars", "_path_chars")


def train(labels: DataFrame, most: int = MOST_LABELS) -> list[float]:
    """Weights of the n-gram buckets, then the intercept, by gradient steps on the driver.

    The n-grams of at most `most` labelled rows, those of the smallest hashes, are gathered for that.
    """
    rows = labels.where("label in (0, 1) and url is not null").orderBy(F.xxhash64("url"), "url", "label").limit(most)
    got = with_grams(rows.select("label", "url"), host_of(F.col("url")), path_of(F.col("url")), "g").select("label", "g").collect()
    y = np.array([r["label"] for r in got], float)
    w, intercept = np.zeros(WIDTH), 0.0
    if not len(y) or y.min() == y.max():
        return [*w.tolist(), 0.0 if not len(y) else 4 * (2 * y[0] - 1)]
    n = np.array([len(r["g"]) for r in got])
    of, own = np.repeat(np.arange(len(got)), n), np.array([g for r in got for g in r["g"]])
    scale = 1 / np.sqrt(n[of])
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())  # both classes count alike
    speed, turn = np.zeros(WIDTH), 0.0
    for _ in range(STEPS):
        e = (1 / (1 + np.exp(-np.bincount(of, w[own] * scale, len(y)) - intercept)) - y) * weight
        speed = 0.9 * speed + np.bincount(own, e[of] * scale, WIDTH) + PENALTY * w
        turn = 0.9 * turn + e.sum()
        w, intercept = w - RATE * speed, intercept - RATE * turn
    return [*w.tolist(), float(intercept)]


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """Judges every url: page_id, host, path, rule (or null), verdict (allow or block), score (of block).

    A rule fits its host and all subdomains where the path starts with the rule's; the longest
    wins; without one, logistic regression decides at 0.5. A null url, or one without ://, has an empty
    host and path and is scored as such. Repeated rows are judged each; other columns are not read.
    """
    weights = train(labels)
    table = F.split(F.lit(",".join(f"{w:.6g}" for w in weights[:-1])), ",").cast("array<double>")  # one literal once it is folded
    p = pages.select(F.col(page_id).alias("page_id"), F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"), F.coalesce(path_of(F.col(url)), F.lit("")).alias("path"))
    sums = F.aggregate("_grams", F.lit(0.0), lambda acc, g: acc + F.element_at(table, g + 1))
    margin = sums / F.sqrt(F.greatest(F.size("_grams"), F.lit(1))) + weights[-1]
    p = with_grams(p, F.col("host"), F.col("path"), "_grams").withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("score", 1 / (1 + F.exp(-margin)))
    return p.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
