"""Words that names and addresses are made comparable by."""

# long forms and variants -> the form that stands for them
SHORT = {
    "incorporated": "inc",
    "corporation": "corp",
    "company": "co",
    "limited": "ltd",
    "private": "pvt",
    "compagnie": "cie",
    "societe": "ste",
    "sainte": "ste",
    "suite": "ste",
    "etablissement": "ets",
    "etablissements": "ets",
    "enterprise": "ent",
    "enterprises": "ent",
    "industry": "ind",
    "industries": "ind",
    "international": "intl",
    "technology": "tech",
    "technologies": "tech",
    "service": "svc",
    "services": "svc",
    "brothers": "bros",
    "manufacturing": "mfg",
    "associates": "assoc",
    "solution": "sol",
    "solutions": "sol",
    "shree": "sri",
    "shri": "sri",
    "sree": "sri",
    "et": "and",
    "und": "and",
    "y": "and",
    "street": "st",
    "saint": "st",
    "road": "rd",
    "avenue": "ave",
    "av": "ave",
    "boulevard": "blvd",
    "bd": "blvd",
    "drive": "dr",
    "lane": "ln",
    "place": "pl",
    "highway": "hwy",
    "parkway": "pkwy",
    "court": "ct",
    "square": "sq",
    "chemin": "ch",
    "route": "rte",
    "impasse": "imp",
    "allee": "all",
    "faubourg": "fbg",
    "floor": "fl",
    "flr": "fl",
    "building": "bldg",
    "apartment": "apt",
    "appartement": "apt",
    "sector": "sec",
    "centre": "ctr",
    "center": "ctr",
    "mount": "mt",
    "district": "dist",
    "number": "no",
    "num": "no",
    "near": "nr",
    "opposite": "opp",
    "north": "n",
    "south": "s",
    "east": "e",
    "west": "w",
}

# legal forms
LEGAL = ("inc", "corp", "co", "ltd", "pvt", "llc", "llp", "lp", "plc", "pllc", "pte", "opc", "sarl", "sas", "sasu", "sa", "eurl", "sci", "snc", "scop", "selarl", "gmbh", "ag", "bv", "srl", "spa", "cie", "ste", "ets")

# words that a name's core leaves out
NAME_STOP = ("and", "the", "of", "de", "du", "des", "la", "le", "les", "l", "d", "s")

# words that announce a landmark
LANDMARK = ("nr", "opp", "behind", "beside", "next", "adjacent", "facing", "pres", "cote", "vis")
