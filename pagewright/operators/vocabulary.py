"""A vocabulary as a relation, look-ups in it, and fuzzy matching of words.

The vocabulary is small and comes as a DataFrame, so that any other can take
its place. Fuzzy matching never compares all pairs: words and entries meet on
their consonant skeleton, then, where that gives nothing, on skeletons with
one consonant left out on either side; edit distances decide about what met.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.devanagari import skeleton

# Words by domain; a word that several domains have belongs to the first.
WORDS = {
    "legal": (
        "अदालत", "सर्वोच्च", "उच्च", "जिल्ला", "न्यायालय", "न्यायाधीश", "न्यायपालिका", "वकील", "अभिवक्ता", "प्रतिवादी", "वादी", "मुद्दा", "फैसला",
        "आदेश", "निर्णय", "पुनरावेदन", "कानून", "ऐन", "नियमावली", "विनियमावली", "संविधान", "अध्यादेश", "दफा", "उपदफा", "खण्ड", "अनुसूची", "परिच्छेद",
        "भाग", "प्रकरण", "व्याख्या", "परन्तुक", "स्पष्टीकरण", "अभियोग", "प्रमाण", "गवाही", "साक्षी", "बयान", "जाँच", "अनुसन्धान", "तहकिकात", "पक्राउ",
        "गिरफ्तारी", "जमानत", "धरौटी", "थुनामा", "कैद", "जरिवाना", "लिखत", "सम्झौता", "अनुबन्ध", "करार", "करारनामा", "अधिकारपत्र", "प्रमाणपत्र",
        "विश्वासपत्र", "नेपाल", "सरकार", "मन्त्रालय", "विभाग", "कार्यालय", "आयोग", "समिति", "निकाय", "प्रदेश", "स्थानीय", "पालिका", "गाउँपालिका",
        "नगरपालिका", "महानगरपालिका", "संसद", "प्रतिनिधिसभा", "राष्ट्रियसभा", "अधिकार", "कर्तव्य", "दायित्व", "जिम्मेवारी", "जवाफदेही", "हक", "अपराध",
        "दण्ड", "सजाय", "क्षतिपूर्ति", "मुआब्जा", "हर्जाना", "रकम", "वैधानिकता",
    ),
    "accounting": (
        "खाता", "जर्नल", "खातावही", "खाताबही", "बही", "नामेसी", "जम्मा", "शेष", "बाँकी", "रकम", "नगद", "चेक", "ड्राफ्ट", "भौचर", "वासलात",
        "नाफानोक्सान", "आर्थिक", "विवरण", "तुलनपत्र", "नगदप्रवाह", "लेखापरीक्षण", "सम्पत्ति", "चलसम्पत्ति", "अचलसम्पत्ति", "स्थिरसम्पत्ति", "पूँजीगत",
        "हिसाब", "मौज्दात", "दायित्व", "चालू", "दीर्घकालीन", "ऋण", "कर्जा", "देय", "भुक्तानी", "तिर्नुपर्ने", "आम्दानी", "आय", "खर्च", "व्यय", "नाफा",
        "नोक्सान", "राजस्व", "प्राप्ति", "बिक्री", "खरीद", "पूँजी", "सेयर", "शेयर", "लाभांश", "सञ्चित", "कोष", "जगेडा", "सुरक्षित", "कर", "करयोग्य",
        "भ्याट", "मूल्य", "अभिवृद्धि", "आयकर", "अग्रिम", "कर्तव्य", "छुट", "रुपैयाँ", "पैसा", "हजार", "लाख", "करोड", "अर्ब", "प्रतिशत", "वर्ष",
        "चैत्र", "बैशाख", "जेठ", "असार", "श्रावण", "भदौ", "असोज", "कात्तिक", "मंसिर", "पौष", "माघ", "फाल्गुन",
    ),
    "banking": (
        "बैंक", "बैंकिङ", "निक्षेप", "बचत", "चल्ती", "स्थिर", "मुद्दती", "ब्याज", "ब्याजदर", "सापटी", "ऋणपत्र", "धितोपत्र", "प्रतिभूति", "विनिमय",
        "हुण्डी", "पत्र", "प्रत्याभूति", "लगानी", "कारोबार", "भुक्तानी", "निकासी", "जम्मा", "खाता", "शाखा", "केन्द्रीय",
    ),
    "common": (
        "र", "को", "का", "की", "ले", "मा", "बाट", "सम्म", "लाई", "प्रति", "सँग", "देखि", "भन्दा", "पनि", "तर", "वा", "अथवा", "तथा", "एवं", "यो",
        "त्यो", "यी", "ती", "कुनै", "सबै", "प्रत्येक", "गर्नु", "हुनु", "भएको", "गरेको", "गरिएको", "बनाउनु", "दिनु", "लिनु", "राख्नु", "हेर्नु",
        "गर्न", "हुन", "भए", "गरे", "गरि", "व्यक्ति", "संस्था", "कम्पनी", "कर्मचारी", "अधिकारी", "निर्देशक", "सदस्य", "अध्यक्ष", "सचिव", "प्रमुख",
        "जनता", "नागरिक", "राष्ट्र", "देश", "प्रदेश", "एक", "दुई", "तीन", "चार", "पाँच", "छ", "सात", "आठ", "नौ", "दश", "सय", "हजार", "लाख", "दिन",
        "हप्ता", "महिना", "वर्ष", "साल", "मिति", "समय", "अवधि", "अन्तर्गत", "भित्र", "पछि", "नयाँ", "पुरानो", "ठूलो", "सानो", "पहिलो", "अन्तिम",
        "मुख्य", "विशेष", "सामान्य", "आवश्यक",
    ),
}


def vocabulary(spark: SparkSession, words: dict[str, tuple[str, ...]] = WORDS) -> DataFrame:
    """word, domain, skeleton: each word once, under its first domain."""
    first: dict[str, str] = {}
    for domain, listed in words.items():
        for w in listed:
            first.setdefault(w, domain)
    return spark.createDataFrame(list(first.items()), "word string, domain string").withColumn("skeleton", skeleton(F.col("word")))


def skeleton_index(vocab: DataFrame) -> DataFrame:
    """skeleton, words: the words of each skeleton, sorted."""
    return vocab.where("skeleton <> ''").groupBy("skeleton").agg(F.array_sort(F.collect_list("word")).alias("words"))


def known(words: DataFrame, vocab: DataFrame, column: str = "word") -> DataFrame:
    """words with domain, null where the vocabulary hasn't the word."""
    return words.join(vocab.select(F.col("word").alias("_w"), "domain"), F.col(column) == F.col("_w"), "left").drop("_w")


def _less_one(c):
    """A string and all strings that leave out one of its characters."""
    n = F.length(c)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n)))
    return F.array_distinct(F.concat(F.array(c), F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))))


def closest_words(words: DataFrame, vocab: DataFrame, most: int = 2, domain: str | None = None, top: int = 5) -> DataFrame:
    """word, candidate, distance, domain, rank for the distinct words of column word: up to top vocabulary words.

    First candidates have the word's own skeleton (and the domain asked for);
    if there is none, those whose skeleton is one edit away, of any domain.
    Ties are settled by the candidate.
    """
    asked = words.select("word").distinct().where("word is not null").withColumn("skeleton", skeleton(F.col("word")))
    entries = vocab.select(F.col("word").alias("candidate"), "domain", F.col("skeleton").alias("entry_skeleton")).where("entry_skeleton <> ''")
    near = lambda df: df.withColumn("distance", F.levenshtein("word", "candidate")).where(F.col("distance") <= most)
    exact = near(asked.join(entries, asked["skeleton"] == entries["entry_skeleton"])).select("word", "candidate", "distance", "domain")
    exact = exact if domain is None else exact.where(F.col("domain") == domain)
    rest = asked.join(exact.select("word").distinct(), "word", "left_anti").where(F.length("skeleton") >= 2)
    left = rest.select("word", "skeleton", F.explode(_less_one(F.col("skeleton"))).alias("key"))
    right = entries.select("candidate", "domain", "entry_skeleton", F.explode(_less_one(F.col("entry_skeleton"))).alias("key"))
    met = left.join(right, "key").where(F.levenshtein("skeleton", "entry_skeleton") <= 1).select("word", "candidate", "domain").distinct()
    found = exact.unionByName(near(met).select("word", "candidate", "distance", "domain"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy("distance", "candidate"))).where(F.col("rank") <= top)


def corrected_words(words: DataFrame, vocab: DataFrame, domain: str | None = None) -> DataFrame:
    """word, corrected, confidence, source for the distinct words: 100 for a known one, 85 and 65 for one and two edits, else 30."""
    asked = words.select("word").distinct().where("word is not null")
    best = closest_words(words, vocab, 2, domain, 1).select("word", "candidate", "distance", F.col("domain").alias("found_domain"))
    both = known(asked, vocab).join(best, "word", "left")
    exact = F.col("domain").isNotNull()
    kind = F.when(F.col("distance") == 0, "exact_").when(F.col("distance") == 1, "near_match_").otherwise("fuzzy_match_")
    return both.select(
        "word",
        F.when(exact, F.col("word")).otherwise(F.coalesce("candidate", "word")).alias("corrected"),
        F.when(exact, 100.0).when(F.col("distance") == 0, 100.0).when(F.col("distance") == 1, 85.0).when(F.col("distance") == 2, 65.0).otherwise(30.0).alias("confidence"),
        F.when(exact, "exact_match").when(F.col("candidate").isNotNull(), F.concat(kind, "found_domain")).otherwise("unknown").alias("source"),
    )
