"""Texts, lists and lookup tables that results must reproduce."""

# Status and trend texts.
INCREASING = "Significantly increasing trend"
DECREASING = "Significantly decreasing trend"
INSUFFICIENT = "Insufficient data to calculate trend"
NO_FIT = "Model did not fit the available data"
NO_TREND = "No significant trend"
STATUSES = ["Active", "Historical"]
NO_FIGURE = "FALSE"

# Habitat code, name.
HABITATS = [
    ("sav", "Submerged Aquatic Vegetation"),
    ("oyster", "Oyster Reef"),
    ("coral", "Coral Reef"),
    ("cw", "Coastal Wetlands"),
    ("nekton", "Nekton"),
]

# File-name token of each habitat layer (compared without case).
HABITAT_TOKENS = ["SAV", "NEKTON", "CORAL", "OYSTER", "CW"]

# Entities shown first, in this order.
HIGHLIGHTS = [
    "Aquatic Preserve Continuous Water Quality Program",
    "National Estuarine Research Reserve SWMP",
]

# Entity whose link is always derived from its program id.
ALWAYS_LINKED = ["USGS Coral Reef Ecosystem Studies (CREST) Project"]

# Parameters left out of the habitat views.
EXCLUDED_PARAMETERS = [
    "Number of Oysters Counted - Dead",
    "Number of Oysters Counted - Live",
    "Number of Oysters Counted - Total",
    "Reef Height",
    "Stem Density",
    "Colony Width",
    "Colony Length",
    "Colony Height",
    "Colony Diameter",
]

# Parameter, unit.
PARAMETER_UNITS = [
    ("Dissolved Oxygen", "mg/L"),
    ("Dissolved Oxygen Saturation", "%"),
    ("pH", "pH"),
    ("Salinity", "ppt"),
    ("Turbidity", "NTU"),
    ("Water Temperature", "Degrees C"),
]

# Long program name, short form.
SHORT_PROGRAMS = [
    ("Aquatic Preserves Continuous Water Quality Monitoring", "APCWQ"),
    ("Aquatic Preserve Continuous Water Quality Monitoring", "APCWQ"),
    ("National Estuarine Research Reserve System-Wide Monitoring Program", "NERR SWMP"),
]

# Short parameter, activity, depth of the water-quality inputs to combine.
INPUT_RULES = [
    ("ChlaC", "Lab", "All"),
    ("Chla", "Lab", "All"),
    ("CDOM", "Lab", "All"),
    ("DO", "Field", "All"),
    ("DOS", "Field", "All"),
    ("pH", "Field", "All"),
    ("Sal", "All", "All"),
    ("Secchi", "Field", "Surface"),
    ("TN", "Lab", "All"),
    ("TP", "Lab", "All"),
    ("TSS", "All", "All"),
    ("Turb", "All", "All"),
    ("TempW", "Field", "All"),
]

# Plot type, title, alternative text, label, habitat.
PLOTS = [
    ("multiplot", "Median percent cover for ", "Median Percent LME Trends",
     "Median percent cover", "Submerged Aquatic Vegetation"),
    ("barplot_sp", "Frequency of occurrence for ", "Occurrence frequency by species",
     "Frequency of occurrence", "Submerged Aquatic Vegetation"),
    ("trendplot", "Median percent cover for ", "Median Percent LME Trends",
     "Median percent cover trends", "Submerged Aquatic Vegetation"),
    ("Oyster_Dens", "Oyster Density trends for ", "Oyster Density trends",
     "Oyster Density", "Oyster Reef"),
    ("Oyster_SH", "Oyster Size Class trends for ", "Oyster Size Class",
     "Oyster Size Class", "Oyster Reef"),
    ("Oyster_PrcLive", "Oyster Percent Live Cover trends for ", "Oyster Percent Live Cover trends",
     "Oyster Percent Live Cover", "Oyster Reef"),
    ("Nekton_SpeciesRichness", "Nekton Species Richness for ", "Nekton Species Richness",
     "Nekton Species Richness", "Nekton"),
    ("Coral_pc", "Coral Percent Cover trend for ", "Coral Percent Cover",
     "Coral Percent Cover", "Coral Reef"),
    ("Coral_SpeciesRichness", "Grazers and Reef-Dependent Species Richness for ",
     "Grazers and Reef-Dependent Species Richness",
     "Grazers and Reef-Dependent Species Richness", "Coral Reef"),
    ("CoastalWetlands_SpeciesRichness", "Coastal Wetlands Species Richness for ",
     "Coastal Wetlands Species Richness", "Coastal Wetlands Species Richness", "Coastal Wetlands"),
]

# Plot types whose figure is found by the blank-free area name;
# all others are found by the area abbreviation.
FIGURES_BY_NAME = [
    "Nekton_SpeciesRichness",
    "Coral_pc",
    "Coral_SpeciesRichness",
    "CoastalWetlands_SpeciesRichness",
]

# Plot types shown without a trend table.
FIGURES_WITHOUT_TABLE = ["barplot_sp"]
