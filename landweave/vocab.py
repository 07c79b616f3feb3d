"""Vocabularies that results must agree on."""

# Tags of polygons in scope.
LANDUSE_TAGS = ("farmland", "farmyard", "meadow", "orchard", "vineyard", "forest", "allotments", "plant_nursery", "greenhouse_horticulture", "grass")
NATURAL_TAGS = ("wood", "scrub", "grassland", "wetland", "heath", "water", "bare_rock", "sand", "scree", "shingle", "beach", "mud")

# Level-2 land-cover classes.
LEVEL2_CLASSES = {
    "21": "Arable land",
    "22": "Permanent crops",
    "23": "Pastures",
    "24": "Heterogeneous agricultural areas",
    "31": "Forests",
    "32": "Shrub and/or herbaceous vegetation associations",
    "33": "Open spaces with little or no vegetation",
    "41": "Inland wetlands",
    "51": "Inland waters",
}
LEVEL2_LABELS = tuple(LEVEL2_CLASSES)

# Evidence vocabulary.
EVIDENCE_TYPES = ("forest", "agriculture", "vineyard", "pasture", "water", "wetland", "shrubland", "bare_ground", "urban_or_artificial", "relief_or_geology", "habitat_or_ecology")
RELEVANCE_LEVELS = ("none", "low", "medium", "high")
UNCERTAINTY_LEVELS = ("low", "medium", "high")

# Words that point to an evidence type.
EVIDENCE_KEYWORDS = {
    "agriculture": ("agricole", "agriculture", "culture", "cultures", "terres agricoles"),
    "bare_ground": ("roche", "éboulis", "sable", "sol nu", "improductif"),
    "forest": ("forêt", "forêts", "forestier", "bois", "boisé", "boisée", "boisements"),
    "habitat_or_ecology": ("habitat", "écologie", "écologique", "réserve naturelle", "protégé"),
    "orchard": ("verger", "vergers"),
    "pasture": ("prairie", "prairies", "pâturage", "pâturages", "herbage"),
    "relief_or_geology": ("altitude", "montagne", "relief", "géologie", "versant", "vallée"),
    "shrubland": ("lande", "landes", "broussailles", "arbustes", "pelouse"),
    "urban_or_artificial": ("bâtiments", "route", "routes", "urbanisé", "aménagé"),
    "vineyard": ("vigne", "vignes", "vignoble", "viticole"),
    "water": ("rivière", "rivières", "lac", "lacs", "eau", "cours d eau", "étang"),
    "wetland": ("zone humide", "zones humides", "tourbière", "marais", "humide"),
}

# Article types in order of preference, with the words of categories that name them.
ARTICLE_TYPE_WORDS = {
    "water_feature": ("rivière", "fleuve", "ruisseau", "lac", "étang", "etang", "canal", "cours d'eau", "cascade", "source", "hydrologie", "hydrographie"),
    "natural_landscape": ("montagne", "massif", "vallée", "vallee", "forêt", "foret", "bois", "réserve naturelle", "reserve naturelle", "parc naturel", "zone naturelle", "sommet", "col", "paysage", "géologie", "geologie", "falaise", "grotte", "prairie naturelle"),
    "agriculture_or_vineyard": ("vignoble", "vin", "viticulture", "agriculture", "agricole", "culture", "céréale", "cereale", "prairie", "paturage", "verger", "exploitation agricole"),
    "built_or_cultural_site": ("château", "chateau", "église", "eglise", "abbaye", "monument", "musée", "musee", "bâtiment", "batiment", "patrimoine", "site archeologique", "architecture", "édifice", "edifice", "chapelle"),
    "transport_infrastructure": ("gare", "route", "autoroute", "canal de navigation", "voie ferrée", "voie ferree", "pont", "tunnel", "transport"),
    "settlement_or_administrative": ("commune", "village", "localité", "localite", "département", "departement", "canton", "arrondissement", "intercommunalité", "intercommunalite", "ancienne commune", "quartier", "lieu-dit"),
    "person_or_event": ("naissance", "décès", "deces", "personnalité", "personnalite", "personne", "bataille", "événement", "evenement", "biographie", "homme politique", "ecrivain", "écrivain", "artiste"),
}
ARTICLE_TYPES = (*ARTICLE_TYPE_WORDS, "other_or_unclear")
HIGH_PRIOR_TYPES = ("agriculture_or_vineyard", "natural_landscape", "water_feature")

# Text sources in order of reports, and which of them are shuffled controls.
SHUFFLED_OF = {
    "summary": "summary_shuffled",
    "summary_no_place": "summary_no_place_shuffled",
    "landuse_evidence_summary": "landuse_evidence_summary_shuffled",
    "evidence_card": "evidence_card_shuffled",
    "content_with_evidence_card": "content_with_evidence_card_shuffled",
    "content_with_evidence_highlights": "content_with_evidence_highlights_shuffled",
    "retrieved_evidence_windows": "retrieved_evidence_windows_shuffled",
    "content": "content_shuffled",
}
TEXT_SOURCES = (
    "summary", "summary_no_place", "landuse_evidence_summary", "evidence_card", "content_with_evidence_card",
    "content_with_evidence_highlights", "retrieved_evidence_windows", "retrieved_evidence_sentences_only", "random_sentence_windows",
    "retrieved_evidence_windows_no_place", "content", "summary_shuffled", "summary_no_place_shuffled", "landuse_evidence_summary_shuffled",
    "evidence_card_shuffled", "content_with_evidence_card_shuffled", "content_with_evidence_highlights_shuffled",
    "retrieved_evidence_windows_shuffled", "content_shuffled",
)

# French names in text artifacts.
ARTICLE_TYPE_NAMES = {
    "other_or_unclear": "autre / non précisé",
    "water_feature": "caractéristique hydrographique",
    "natural_landscape": "paysage naturel",
    "agriculture_or_vineyard": "agriculture ou vignoble",
    "built_or_cultural_site": "site bâti ou culturel",
    "transport_infrastructure": "infrastructure de transport",
    "settlement_or_administrative": "zone urbaine / administrative",
    "person_or_event": "personne ou événement",
}
QUALITY_BIN_NAMES = {"quality_low": "qualité faible", "quality_medium": "qualité moyenne", "quality_high": "qualité élevée", "quality_very_high": "qualité très élevée"}
USE_NAMES = {"use_for_training": "utilisable pour entraînement", "use_for_evaluation_only": "réservé à l'évaluation", "inspect_manually": "à inspecter manuellement", "exclude": "à exclure"}
RELEVANCE_NAMES = {"none": "aucune", "low": "faible", "medium": "moyenne", "high": "élevée"}
UNCERTAINTY_NAMES = {"low": "faible", "medium": "moyenne", "high": "élevée"}
EVIDENCE_TYPE_NAMES = {
    "forest": "forêt",
    "agriculture": "agriculture",
    "vineyard": "vignoble",
    "pasture": "prairie ou pâturage",
    "water": "eau",
    "wetland": "zone humide",
    "shrubland": "végétation arbustive ou herbacée",
    "bare_ground": "sol nu ou rocheux",
    "urban_or_artificial": "urbain ou artificiel",
    "relief_or_geology": "relief ou géologie",
    "habitat_or_ecology": "habitat ou écologie",
}

# Spellings of weakly typed booleans.
TRUE_WORDS = ("true", "t", "yes", "y", "oui", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "non", "off", "0")

# Weights and scores of supervision quality.
RELEVANCE_WEIGHT = {"none": 0.25, "low": 0.60, "medium": 1.00, "high": 1.25}
UNCERTAINTY_WEIGHT = {"high": 0.40, "medium": 0.75, "low": 1.00}
RELEVANCE_SCORE = {"high": 3, "medium": 2, "low": 1}
UNCERTAINTY_PENALTY = {"low": 0, "medium": 1, "high": 2}
ARTICLE_TYPE_SCORE = {"agriculture_or_vineyard": 2, "natural_landscape": 2, "water_feature": 2, "settlement_or_administrative": 1, "built_or_cultural_site": 1}
QUALITY_BIN_EDGES = (("quality_low", 3.0), ("quality_medium", 5.0), ("quality_high", 7.0))
