"""Law numbers, names, aliases and words that decide identities. They must not change."""

#: number -> canonical law name
LAW_BY_NUMBER = {
    "193": "Gelir Vergisi Kanunu",
    "197": "Motorlu Taşıtlar Vergisi Kanunu",
    "213": "Vergi Usul Kanunu",
    "488": "Damga Vergisi Kanunu",
    "492": "Harçlar Kanunu",
    "1319": "Emlak Vergisi Kanunu",
    "2464": "Belediye Gelirleri Kanunu",
    "3065": "Katma Değer Vergisi Kanunu",
    "3194": "İmar Kanunu",
    "3218": "Serbest Bölgeler Kanunu",
    "4458": "Gümrük Kanunu",
    "4721": "Türk Medeni Kanunu",
    "4760": "Özel Tüketim Vergisi Kanunu",
    "4857": "İş Kanunu",
    "5018": "Kamu Mali Yönetimi ve Kontrol Kanunu",
    "5510": "Sosyal Sigortalar ve Genel Sağlık Sigortası Kanunu",
    "5520": "Kurumlar Vergisi Kanunu",
    "6098": "Türk Borçlar Kanunu",
    "6102": "Türk Ticaret Kanunu",
    "6183": "Amme Alacaklarının Tahsil Usulü Hakkında Kanun",
    "6802": "Gider Vergileri Kanunu",
}
#: names that a repealed law shares with its successor: they decide no number
SHARED_NAMES = ("İş Kanunu", "Türk Ticaret Kanunu", "Gümrük Kanunu", "İmar Kanunu", "Kurumlar Vergisi Kanunu")
#: a name that decides a number though the number has no canonical name
NUMBER_BY_NAME = {n: k for k, n in LAW_BY_NUMBER.items() if n not in SHARED_NAMES} | {"Veraset ve İntikal Vergisi Kanunu": "7338"}
#: every number that a name can stand for
NUMBERS_BY_NAME = {n: (k,) for k, n in LAW_BY_NUMBER.items()} | {
    "Kurumlar Vergisi Kanunu": ("5422", "5520"),
    "İş Kanunu": ("931", "1475", "3008", "4857"),
    "Türk Ticaret Kanunu": ("6762", "6102"),
    "Gümrük Kanunu": ("1615", "4458"),
    "İmar Kanunu": ("6785", "3194"),
    "Medeni Kanun": ("743", "4721"),
    "Borçlar Kanunu": ("818", "6098"),
    "Veraset ve İntikal Vergisi Kanunu": ("7338",),
}
#: alias -> law name; letters are folded at the lookup, so the forms in plain ASCII need no entries of their own
ALIASES = {
    "vuk": "Vergi Usul Kanunu",
    "vergi usul kanunu": "Vergi Usul Kanunu",
    "gvk": "Gelir Vergisi Kanunu",
    "gelir vergisi kanunu": "Gelir Vergisi Kanunu",
    "kvk": "Kurumlar Vergisi Kanunu",
    "kurumlar vergisi kanunu": "Kurumlar Vergisi Kanunu",
    "kdvk": "Katma Değer Vergisi Kanunu",
    "kdv kanunu": "Katma Değer Vergisi Kanunu",
    "katma değer vergisi kanunu": "Katma Değer Vergisi Kanunu",
    "ötvk": "Özel Tüketim Vergisi Kanunu",
    "ötv kanunu": "Özel Tüketim Vergisi Kanunu",
    "özel tüketim vergisi kanunu": "Özel Tüketim Vergisi Kanunu",
    "dvk": "Damga Vergisi Kanunu",
    "damga vergisi kanunu": "Damga Vergisi Kanunu",
    "harçlar kanunu": "Harçlar Kanunu",
    "gider vergileri kanunu": "Gider Vergileri Kanunu",
    "gider vergisi kanunu": "Gider Vergileri Kanunu",
    "emlak vergisi kanunu": "Emlak Vergisi Kanunu",
    "emlak kanunu": "Emlak Vergisi Kanunu",
    "belediye gelirleri kanunu": "Belediye Gelirleri Kanunu",
    "veraset ve intikal vergisi kanunu": "Veraset ve İntikal Vergisi Kanunu",
    "veraset ve intikal kanunu": "Veraset ve İntikal Vergisi Kanunu",
    "türk ticaret kanunu": "Türk Ticaret Kanunu",
    "ttk": "Türk Ticaret Kanunu",
    "sosyal sigortalar ve genel sağlık sigortası kanunu": "Sosyal Sigortalar ve Genel Sağlık Sigortası Kanunu",
    "ssgsk": "Sosyal Sigortalar ve Genel Sağlık Sigortası Kanunu",
    "türk medeni kanunu": "Türk Medeni Kanunu",
    "tmk": "Türk Medeni Kanunu",
    "motorlu taşıtlar vergisi kanunu": "Motorlu Taşıtlar Vergisi Kanunu",
    "mtvk": "Motorlu Taşıtlar Vergisi Kanunu",
    "mtv kanunu": "Motorlu Taşıtlar Vergisi Kanunu",
    "serbest bölgeler kanunu": "Serbest Bölgeler Kanunu",
    "sbk": "Serbest Bölgeler Kanunu",
    "türk borçlar kanunu": "Türk Borçlar Kanunu",
    "tbk": "Türk Borçlar Kanunu",
    "gümrük kanunu": "Gümrük Kanunu",
    "imar kanunu": "İmar Kanunu",
    "iş kanunu": "İş Kanunu",
    "aatuhk": "Amme Alacaklarının Tahsil Usulü Hakkında Kanun",
    "aatk": "Amme Alacaklarının Tahsil Usulü Hakkında Kanun",
    "amme alacaklarının tahsil usulü hakkında kanun": "Amme Alacaklarının Tahsil Usulü Hakkında Kanun",
    "amme alacakları kanunu": "Amme Alacaklarının Tahsil Usulü Hakkında Kanun",
    "kmykk": "Kamu Mali Yönetimi ve Kontrol Kanunu",
    "kamu mali yönetimi ve kontrol kanunu": "Kamu Mali Yönetimi ve Kontrol Kanunu",
}
#: words of a law's name that name no particular law (folded)
CONTENTLESS = ("kanun", "kanunu", "kanunun", "kanununun", "sayili", "bu", "mezkur", "ilgili", "adi", "gecen")
#: numbers that say "no number"
EMPTY_NUMBERS = ("null", "none", "nan", "yok", "-", "—", "–", "n/a")
#: article qualifiers, and their abbreviations; the qualifiers of five letters or more allow one slip
QUALIFIERS = ("ek", "geçici", "mükerrer")
QUALIFIER_ABBREVIATIONS = {"muk": "mükerrer", "gec": "geçici"}
#: endings of ordinal numbers
ORDINAL_ENDINGS = ("inci", "ıncı", "uncu", "üncü", "nci", "ncı", "ncu", "ncü")
#: words that say "and the following" after "ve" (folded); "devam" also with an ending, "takip" with "eden"
FOLLOWING = ("muteakip", "mutakip", "izleyen", "devam", "takip", "sonraki")
#: forms of the word article after its number, and its abbreviations
ARTICLE_FORMS = ("madde", "maddesi", "maddesinin", "maddesinde", "maddesinden")
ARTICLE_ABBREVIATIONS = ("md", "mad", "m")
#: widest range of articles that is spelt out
WIDEST_RANGE = 300
#: policies: (number, article) pairs that one removes from every list
POLICIES = {"none": (), "ignore_vuk_213_article_413_v1": (("213", "413"),)}
