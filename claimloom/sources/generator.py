"""A seeded synthetic corpus of claims: the same seed gives the same rows on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shares of the corpus and the sets that values are drawn from.
CHANNELS = (("email", 0.5), ("web_form", 0.3), ("call_transcript", 0.2))
CONTENT = (("claim", 0.9), ("info_request", 0.08), ("irrelevant", 0.02))
DAMAGES = ("collision", "single_vehicle", "glass", "hail", "fire", "theft", "animal", "other")
INJURY_SHARE, HIGH_SHARE, NO_AMOUNT_SHARE, NO_DISTRICT_SHARE = 0.08, 0.30 / 0.92, 0.15, 0.4
CITIES = (
    ("İstanbul", "Kadıköy", "Üsküdar", "Şişli"), ("Ankara", "Çankaya", "Keçiören", "Mamak"), ("İzmir", "Bornova", "Konak", "Karşıyaka"), ("Bursa", "Nilüfer", "Osmangazi", "İnegöl"),
    ("Antalya", "Muratpaşa", "Kepez", "Alanya"), ("Adana", "Seyhan", "Çukurova", "Ceyhan"), ("Konya", "Selçuklu", "Meram", "Ereğli"), ("Gaziantep", "Şahinbey", "Şehitkamil", "Nizip"),
    ("Kayseri", "Melikgazi", "Talas", "Develi"), ("Samsun", "İlkadım", "Atakum", "Bafra"), ("Trabzon", "Ortahisar", "Akçaabat", "Of"), ("Eskişehir", "Odunpazarı", "Tepebaşı", "Sivrihisar"),
)
FIRST_NAMES = ("Ahmet", "Ayşe", "Mehmet", "Fatma", "Mustafa", "Zeynep", "Hüseyin", "Elif", "Kemal", "Sevgi", "Murat", "Derya", "Sinan", "Hatice", "Orhan", "Nalan")
LAST_NAMES = ("Yılmaz", "Kaya", "Demir", "Şahin", "Çelik", "Yıldız", "Öztürk", "Aydın", "Özdemir", "Arslan", "Doğan", "Kılıç", "Çetin", "Kara", "Koç", "Polat")
#: What a message says of each kind of damage: three stories and a word for forms.
PHRASES = {
    "collision": ("başka bir araçla çarpıştım", "kavşakta yandan vurdular", "öndeki araca arkadan vurdum", "çarpışma"),
    "single_vehicle": ("bariyere çarptım", "virajda yoldan çıkıp ağaca çarptım", "park ederken duvara sürttüm", "tek taraflı"),
    "glass": ("ön cam çatladı", "sıçrayan taş camı kırdı", "arka cam boydan boya çatlamış", "cam"),
    "hail": ("dolu hasar verdi", "dolu yüzünden kaporta göçtü", "dolu tavanı delik deşik etti", "dolu"),
    "fire": ("motor yandı", "kaputtan alev çıktı", "tesisat tutuştu", "yangın"),
    "theft": ("araç çalındı", "sabah araç yerinde yoktu", "kapıyı zorlayıp teybi almışlar", "hırsızlık"),
    "animal": ("yola çıkan hayvana çarptım", "köpeğe çarpmamak için kırınca tampon gitti", "yola atlayan domuza çarptım", "hayvan"),
    "other": ("araçta hasar var", "sel suyu motora girdi", "üstüne saksı düşmüş", "diğer"),
}
#: Forms of mails, calls and other messages; {} stands for the story in the first two.
MAILS = (
    "Merhaba,\n{}\nSaygılarımla, ", "Sayın yetkili,\n\n{}\n\nGereğini rica ederim.\n", "İyi günler, {}\nDönüşünüzü bekliyorum.\n", "Konu: hasar bildirimi\n{}\nTeşekkürler, ",
    "Selam, acele yazıyorum. {}\n", "Poliçe sahibiyim. {}\nİyi çalışmalar, ", "Dosya açılmasını istiyorum. {}\nSaygılar, ", "{}\nFotoğrafları ayrıca gönderirim.\n",
)
CALLS = (
    "Temsilci: Yaralanan var mı?\nMüşteri: {}", "Temsilci: Hoş geldiniz, ne oldu?\nMüşteri: Şey, {}", "Temsilci: Sizi dinliyorum.\nMüşteri: Yani şöyle, {}", "Temsilci: Hasar mı bildireceksiniz?\nMüşteri: Evet. {}",
)
INFO_REQUESTS = (
    "Poliçem hakkında bilgi almak istiyorum. ", "Kaskom ne zaman bitiyor? ", "Anlaşmalı servisleriniz hangileri? ", "Ödememi taksitlendirebilir miyim? ", "Yeşil kart veriyor musunuz? ", "Poliçeme sürücü ekletmek istiyorum. ",
)
IRRELEVANT = ("Kampanyalarımızı kaçırmayın!", "Toplantı yarına alındı.", "Abonelikten çıkmak için tıklayın.", "Öğle yemeğinde ne var?", "Sipariş verdiğiniz ürün kargoda.", "İyi bayramlar dileriz.")
#: Words of urgency in mails and calls.
URGENT = {"critical": ("Çok acil.", "Hemen dönün lütfen."), "high": ("Mümkünse bugün bakın.", "Araç yürümüyor.")}
LETTERS = "ABCDEFGHIJKLMNOPRSTUVYZ"


def _draw(seed: int, what: str) -> Column:
    """A number in [0, 1) for each id."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col("id")), F.lit(1 << 40)) / float(1 << 40)


def _one_of(values: tuple, draw: Column) -> Column:
    return F.array(*map(F.lit, values))[F.floor(draw * len(values)).cast("int")]


def _weighted(shares: tuple, draw: Column) -> Column:
    out, upto = None, 0.0
    for name, share in shares[:-1]:
        upto += share
        out = F.when(draw < upto, name) if out is None else out.when(draw < upto, name)
    return out.otherwise(shares[-1][0])


def ground_truth(spark: SparkSession, n: int | DataFrame, seed: int = 42, until: str = "2026-08-01") -> DataFrame:
    """gt_id, received_at, expected (the claim's fields) and personal (name, phone, tc) of n messages, or of one for each row of a column id."""
    d = lambda what: _draw(seed, what)
    digits = lambda what, k: F.lpad(F.floor(d(what) * 10**k).cast("string"), k, "0")
    content = _weighted(CONTENT, d("content"))
    claim = content == "claim"
    injury = claim & (d("injury") < INJURY_SHARE)
    damage = _one_of(DAMAGES, d("damage"))
    received = F.timestamp_seconds(F.unix_timestamp(F.lit(until).cast("timestamp")) - F.floor(d("received") * 90 * 86400))
    places = [F.struct(F.lit(city).alias("city"), F.lit(k).alias("district")) for city, *districts in CITIES for k in districts]
    place = F.array(*places)[F.floor(d("place") * len(places)).cast("int")]
    if_claim = lambda v: F.when(claim, v)
    expected = F.struct(
        _weighted(CHANNELS, d("channel")).alias("channel"),
        content.alias("content_type"),
        F.when(injury, "critical").when(d("urgency") < HIGH_SHARE, "high").otherwise("normal").alias("urgency"),
        if_claim(F.concat(F.lit("POL-"), (2020 + F.floor(d("year") * 6)).cast("string"), F.lit("-"), digits("policy", 5))).alias("policy_no"),
        if_claim(F.concat(F.lpad((1 + F.floor(d("province") * 81)).cast("string"), 2, "0"), _one_of(tuple(LETTERS), d("l1")), _one_of(tuple(LETTERS), d("l2")), digits("plate", 3))).alias("plate"),
        if_claim(F.date_sub(F.to_date(received), F.floor(d("before") * 7).cast("int"))).alias("incident_date"),
        if_claim(F.struct(place["city"].alias("city"), F.when(d("district") >= NO_DISTRICT_SHARE, place["district"]).alias("district"))).alias("incident_location"),
        if_claim(damage).alias("damage_type"),
        injury.alias("injury"),
        (claim & (damage == "collision")).alias("counterparty_exists"),
        if_claim(F.when(d("amount?") >= NO_AMOUNT_SHARE, F.round(1000 + d("amount") * 49000, 0))).alias("estimated_amount"),
    )
    personal = F.struct(
        F.concat(_one_of(FIRST_NAMES, d("first")), F.lit(" "), _one_of(LAST_NAMES, d("last"))).alias("name"),
        F.concat(F.lit("05"), digits("phone", 9)).alias("phone"),
        F.concat((1 + F.floor(d("tc1") * 9)).cast("string"), digits("tc2", 10)).alias("tc"),
    )
    rows = spark.range(n) if isinstance(n, int) else n
    return rows.select(F.format_string("GT-%06d", F.col("id") + 1).alias("gt_id"), received.alias("received_at"), expected.alias("expected"), personal.alias("personal"))


def relative_day(days: Column) -> Column:
    """How a message names a day so many days back."""
    return F.when(days == 0, "bugün").when(days == 1, "dün").when(days == 2, "önceki gün").otherwise(F.concat(days.cast("string"), F.lit(" gün önce")))


def _of_kind(pools: dict[str, tuple], kind: Column, draw: Column) -> Column:
    """One of the pool of a kind; null for a kind without a pool."""
    lists = F.create_map(*[x for name, pool in pools.items() for x in (F.lit(name), F.array(*map(F.lit, pool)))])
    pool = F.try_element_at(lists, kind)
    return F.get(pool, F.floor(draw * F.size(pool)).cast("int"))


def _filled(templates: tuple[str, ...], draw: Column, story: Column) -> Column:
    return F.replace(_one_of(templates, draw), F.lit("{}"), story)


def render_texts(truth: DataFrame, seed: int = 42) -> DataFrame:
    """gt_id, channel and text of each record, in its channel's form; a null field is never written. A record's words are drawn by its gt_id."""
    e, p = F.col("expected"), F.col("personal")
    d = lambda what: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col("gt_id")), F.lit(1 << 40)) / float(1 << 40)
    when = relative_day(F.date_diff(F.to_date("received_at"), e["incident_date"]))
    phrase = _of_kind({k: v[:3] for k, v in PHRASES.items()}, e["damage_type"], d("phrase"))
    short = _of_kind({k: v[3:] for k, v in PHRASES.items()}, e["damage_type"], d("short"))
    cue = _of_kind(URGENT, e["urgency"], d("cue"))
    place = F.concat_ws(" ", e["incident_location"]["city"], e["incident_location"]["district"])
    amount = F.concat(F.replace(F.format_number(e["estimated_amount"], 0), F.lit(","), F.lit(".")), F.lit(" TL"))
    facts = (
        ("Poliçe", e["policy_no"]), ("Plaka", e["plate"]), ("Yer", place), ("Tarih", when), ("Hasar", short), ("Açıklama", phrase), ("Not", cue), ("Tutar", amount),
        ("Yaralanma", F.when(e["injury"], "yaralı var").when(d("blank") < 0.1, " ")), ("Karşı taraf", F.when(e["counterparty_exists"], "evet")),
    )
    form = F.concat_ws("\n", *[F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{n}: "), v)) for n, v in facts], F.concat(F.lit("Ad Soyad: "), p["name"]), F.concat(F.lit("Telefon: "), p["phone"]))
    story = F.concat_ws(
        " ", F.concat(when, F.lit(" "), place, F.lit(" civarında "), phrase, F.lit(".")), F.concat(F.lit("Plakam "), e["plate"], F.lit(".")),
        F.concat(F.lit("Poliçe numaram "), e["policy_no"], F.lit(".")), F.concat(F.lit("Tahmini hasar "), amount, F.lit(".")), F.when(e["injury"], "Kazada yaralanan oldu."), cue,
    )
    mail = F.concat(_filled(MAILS, d("mail"), story), p["name"], F.lit("\n"), p["phone"])
    call = F.concat(_filled(CALLS, d("call"), story), F.lit(" Adım "), p["name"], F.lit(", TC "), p["tc"], F.lit("."))
    by_channel = F.when(e["channel"] == "email", mail).when(e["channel"] == "web_form", form).otherwise(call)
    other = F.when(e["content_type"] == "info_request", F.concat(_one_of(INFO_REQUESTS, d("info")), p["name"])).otherwise(_one_of(IRRELEVANT, d("other")))
    return truth.select("gt_id", e["channel"].alias("channel"), F.when(e["content_type"] == "claim", by_channel).otherwise(other).alias("text"))
