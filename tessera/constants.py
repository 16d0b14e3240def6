"""Fixed values that must equal the original pipeline's for identical results.

Everything in this module is data, not logic: the land-cover class dictionary, the
grid layout, the thresholds and the normalisation constants.  Keep the entries in
their natural order; other modules derive ordinals from the position in these lists.
"""

from __future__ import annotations

# --- fixed values: land-cover classes (code, name), in table column order -------------
CLASS_CODES_AND_NAMES: list[tuple[int, str]] = [
    (111, "continuous urban fabrics"),
    (112, "discontinuous urban fabrics"),
    (121, "industrial or commercial units"),
    (122, "road and rail networks and associated land"),
    (123, "port areas"),
    (124, "airports"),
    (131, "mineral extraction sites"),
    (132, "dump sites"),
    (133, "construction sites"),
    (141, "green urban areas"),
    (142, "sport and leisure facilities"),
    (211, "non-irrigated arable lands"),
    (212, "permanently irrigated lands"),
    (213, "rice fields"),
    (221, "vineyards"),
    (222, "fruit trees and berry plantations"),
    (223, "olive groves"),
    (231, "pastures"),
    (241, "annual crops associated with permanent crops"),
    (242, "complex cultivation patterns"),
    (243, "land principally occupied by agriculture, with significant areas of natural vegetation"),
    (244, "agro-forestry areas"),
    (311, "broad-leaved forests"),
    (312, "coniferous forests"),
    (313, "mixed forests"),
    (321, "natural grasslands"),
    (322, "moors and heathlands"),
    (323, "sclerophyllous vegetation"),
    (324, "transitional woodlands/shrub"),
    (331, "beaches, dunes, sands"),
    (332, "bare rocks"),
    (333, "sparsely vegetated areas"),
    (334, "burnt areas"),
    (411, "inland marshes"),
    (412, "peatbogs"),
    (421, "salt marshes"),
    (422, "salines"),
    (423, "intertidal flats"),
    (511, "water courses"),
    (512, "water bodies"),
    (521, "coastal lagoons"),
    (522, "estuaries"),
    (523, "sea and ocean"),
]
# code without a name that still gets a contiguous id (the last one)
NODATA_CODE = 999
# --- fixed values: grid layout --------------------------------------------------------
BLOCK_SIZE = 30
GRID_COLUMNS = "abcd"  # letter = column (x), digit = row (y)
GRID_ROWS = 4
# --- fixed values: area table ---------------------------------------------------------
MIN_PIXELS = 30  # counts below this become 0; 30 itself is kept
AREA_SCALE = 100
# --- fixed values: output file names --------------------------------------------------
MASK_SUFFIX = "_reference_map.tif"  # 18 characters, cut from the end of a mask file name
SUFFIX_CUT = 18
# --- fixed values: answer labels that contain the separator -------------------------
PROTECTED_ANSWERS = [
    "beaches, dunes, sands",
    "land principally occupied by agriculture, with significant areas of natural vegetation",
]
PLACEHOLDER_FORMAT = "{{{{{i}}}}}"  # renders as {{0}}, {{1}}
# --- fixed values: label vector sizes -------------------------------------------------
PATCH_SLOTS = 16
ANSWER_SLOTS = 335
MAX_LENGTH = 1024
# --- fixed values: per-band normalisation (mean, std) ---------------------------------
NORM_MULTISPECTRAL = ([0.1396, 0.1457, 0.1005], [0.07, 0.0547, 0.0449])
NORM_IMAGENET = ([0.485, 0.456, 0.406], [0.229, 0.224, 0.225])
# --- fixed values: loss clamp (log never below -100) ----------------------------------
LOG_CLAMP = -100.0

# Derived, not fixed: ordinals follow list positions.
CLASS_CODES = [c for c, _ in CLASS_CODES_AND_NAMES]
CLASS_NAMES = [n for _, n in CLASS_CODES_AND_NAMES]
N_CLASSES = len(CLASS_NAMES)  # 43 named classes
ID_CODES = CLASS_CODES + [NODATA_CODE]  # contiguous id = position, 44 ids
N_IDS = len(ID_CODES)
GRID_EXTENT = BLOCK_SIZE * GRID_ROWS  # 120
N_CELLS = len(GRID_COLUMNS) * GRID_ROWS  # 16


def cell_name(grid_ord: int) -> str:
    """Cell name of a grid ordinal (row-major: a1 b1 c1 d1 a2 ...)."""
    return f"{GRID_COLUMNS[grid_ord % len(GRID_COLUMNS)]}{grid_ord // len(GRID_COLUMNS) + 1}"


CELL_NAMES = [cell_name(i) for i in range(N_CELLS)]
