"""Controlled vocabularies of the data model."""

# Subtypes, predicates and relations.
DISRUPTIONS = ("WeatherDisruption", "DisasterEvent", "PestDiseaseEvent", "ProductionDisruption", "SupplyShortage", "DistributionDisruption", "FoodSafetyIncident")
RESPONSES = ("ReserveRelease", "FoodAssistance", "MarketOperationAction", "ProcurementAction", "DistributionIntervention", "ImportExportAction", "InspectionEnforcement", "ProductionAssistance", "CrisisPreparednessAction", "OtherResponseAction")
PREDICATES = ("respondsTo", "reportedCauseOf", "implementsPolicy", "citesPolicy")
STRUCTURAL = ("concernsCommodity", "occursIn", "hasActor", "reportedIn", "sourcePublisher", "publishedBy")
NODE_TYPES = ("event", "policy", "actor", "location", "commodity", "publisher", "article")

# Commodities that match any other, and dates that are precise to the day.
WILDCARDS = ("broad_food", "unclear", "")
PRECISE = ("day", "estimated_day")

# Districts, in the order in which a text is searched for them.
DISTRICTS = (
    "surabaya", "bangkalan", "banyuwangi", "batu", "blitar", "bojonegoro", "bondowoso", "gresik",
    "jember", "jombang", "kediri", "lamongan", "lumajang", "madiun", "magetan", "malang",
    "mojokerto", "nganjuk", "ngawi", "pacitan", "pamekasan", "pasuruan", "ponorogo", "probolinggo",
    "sampang", "sidoarjo", "situbondo", "sumenep", "trenggalek", "tuban", "tulungagung", "madura",
)

# Words of the title screen.
TOPICS = {
    "rice": ("beras", "padi", "gabah"),
    "palm_oil_and_cooking_oil": ("sawit", "cpo", "minyak goreng", "minyakita"),
    "fisheries": ("ikan", "perikanan", "nelayan", "udang", "tambak", "akuakultur"),
    "horticulture": ("cabai", "cabe", "bawang", "hortikultura"),
    "livestock": ("sapi", "ayam", "telur", "ternak", "peternak", "peternakan", "susu"),
    "trade_and_logistics": ("ekspor", "impor", "logistik", "pelabuhan", "distribusi", "rantai pasok"),
    "monetary_and_macro": ("inflasi", "deflasi", "suku bunga", "rupiah", "kurs", "bank indonesia", "pertumbuhan ekonomi", "pdb"),
    "corporate_and_finance": ("emiten", "saham", "dividen", "merger", "akuisisi", "laba", "perbankan", "kredit", "obligasi"),
    "energy": ("bbm", "batubara", "batu bara", "migas", "minyak bumi", "lpg", "elpiji", "gas alam", "listrik", "bensin"),
    "weather_and_disasters": ("banjir", "kekeringan", "cuaca", "el nino", "la nina", "longsor", "bencana"),
}
