"""Rule tables of the four grading schemes. All tables here are fixed values: results depend on each of them."""

from __future__ import annotations

SIDES = ("front", "back")
COMPONENTS = ("corners", "edges", "surface")
SEVERITIES = ("micro", "minor", "moderate", "major")
FLAWLESS = 10.5
UNREAD_SHARE = 55.0
TOLERANCE = 0.5

# Stacking of defects in one component.
STACK_PENALTY = 0.5
MAX_STACK_PENALTY = 1.5
MICRO_STACK_COUNT = 3
MICRO_STACK_GRADE = 9.5
UNCONFIRMED_FLOOR = 9.0

# Defect type, where it can be, its cap at micro, minor, moderate and major, the qualifier it can cause.
DEFECTS = (
    ("corner_whitening", ("corners",), (10, 9, 8, 6), None),
    ("corner_softening", ("corners",), (10, 8.5, 7, 4.5), None),
    ("corner_ding", ("corners",), (9, 8, 6, 4), None),
    ("edge_whitening", ("edges",), (10, 9, 8, 6), None),
    ("edge_chipping", ("edges",), (10, 8.5, 7, 5), None),
    ("edge_silvering", ("edges",), (10, 9.5, 8.5, 7), None),
    ("rough_cut", ("edges",), (10, 9, 8, 7), None),
    ("edge_dent", ("edges",), (9, 8, 6, 4), None),
    ("surface_scratch", ("surface",), (10, 9, 7, 5), None),
    ("holo_scratch", ("surface",), (10, 9, 8, 6), None),
    ("print_line", ("surface",), (10, 9, 8, 7), "PD"),
    ("print_spot", ("surface",), (10, 9, 8, 7), "PD"),
    ("indentation", ("surface",), (9, 8, 6, 4), None),
    ("gloss_loss", ("surface",), (10, 8.5, 6, 4), None),
    ("misregistration", ("surface",), (10, 8.5, 7, 5), "OF"),
    ("stain", ("surface",), (9, 7, 5, 3), "ST"),
    ("writing", ("surface",), (7, 6, 4, 2), "MK"),
    ("crease", ("surface", "corners"), (7, 5, 3.5, 2), None),
    ("miscut", ("edges",), (8, 6, 4, 2), "MC"),
    ("hole", ("surface", "corners", "edges"), (3, 2, 1.5, 1), None),
    ("altered", ("surface", "corners", "edges"), (1, 1, 1, 1), None),
)
FATAL = ("altered",)
#: Qualifier and the component whose defects cause it.
QUALIFIERS = (("PD", "surface"), ("OF", "surface"), ("ST", "surface"), ("MK", "surface"), ("MC", "edges"))

# Labels of each scheme, best first.
PSA = (
    (10, "GEM MT 10"), (9, "MINT 9"), (8.5, "NM-MT+ 8.5"), (8, "NM-MT 8"), (7.5, "NM+ 7.5"), (7, "NM 7"), (6.5, "EX-MT+ 6.5"), (6, "EX-MT 6"), (5.5, "EX+ 5.5"),
    (5, "EX 5"), (4.5, "VG-EX+ 4.5"), (4, "VG-EX 4"), (3.5, "VG+ 3.5"), (3, "VG 3"), (2.5, "GOOD+ 2.5"), (2, "GOOD 2"), (1.5, "FR 1.5"), (1, "PR 1"),
)
BGS = (
    (10, "Pristine 10"), (9.5, "Gem Mint 9.5"), (9, "Mint 9"), (8.5, "NM-MT+ 8.5"), (8, "NM-MT 8"), (7.5, "NM+ 7.5"), (7, "NM 7"), (6.5, "EX-MT+ 6.5"), (6, "EX-MT 6"), (5.5, "EX+ 5.5"),
    (5, "EX 5"), (4.5, "VG-EX+ 4.5"), (4, "VG-EX 4"), (3.5, "VG+ 3.5"), (3, "VG 3"), (2.5, "G+ 2.5"), (2, "G 2"), (1.5, "Fair 1.5"), (1, "Poor 1"),
)
BLACK_LABEL = "Pristine 10 (Black Label)"
CGC = (
    (10.5, "Pristine 10"), (10, "Gem Mint 10"), (9.5, "Mint+ 9.5"), (9, "Mint 9"), (8.5, "NM/Mint+ 8.5"), (8, "NM/Mint 8"), (7.5, "Near Mint+ 7.5"), (7, "Near Mint 7"), (6.5, "Ex/NM+ 6.5"), (6, "Ex/NM 6"),
    (5.5, "Excellent+ 5.5"), (5, "Excellent 5"), (4.5, "VG/Ex+ 4.5"), (4, "VG/Ex 4"), (3.5, "Very Good+ 3.5"), (3, "Very Good 3"), (2.5, "Good+ 2.5"), (2, "Good 2"), (1.5, "Fair 1.5"), (1, "Poor 1"),
)
# Lowest score, grade and label of each TAG band.
TAG_BANDS = (
    (990, 10.5, "Pristine 10"), (950, 10, "Gem Mint 10"), (900, 9, "Mint 9"), (850, 8.5, "NM MT+ 8.5"), (800, 8, "NM MT 8"), (750, 7.5, "NM+ 7.5"), (700, 7, "NM 7"), (650, 6.5, "EX MT+ 6.5"), (600, 6, "EX MT 6"), (550, 5.5, "EX+ 5.5"),
    (500, 5, "EX 5"), (450, 4.5, "VG EX+ 4.5"), (400, 4, "VG EX 4"), (350, 3.5, "VG+ 3.5"), (300, 3, "VG 3"), (250, 2.5, "Good+ 2.5"), (200, 2, "Good 2"), (150, 1.5, "Fair 1.5"), (100, 1, "Poor 1"),
)
ALTERED_LABELS = {"PSA": "AUTHENTIC ALTERED", "BGS": "Authentic Altered", "CGC": "Altered", "TAG": "Altered"}

# Centering rows, best first: grade, front limit of the worse axis, of the better axis, back limit.
CENTERING = {
    "PSA": ((10, 55, None, 75), (9, 60, None, 90), (8, 65, None, 90), (7, 70, None, 90), (6, 80, None, 90), (5, 85, None, 90), (4, 85, None, 90), (3, 90, None, 90), (2, 90, None, 90), (1, 100, None, 100)),
    "BGS": ((10, 55, 50, 60), (9.5, 55, None, 60), (9, 60, 55, 80), (8.5, 65, 60, 90), (8, 65, None, 90), (7, 70, None, 90), (6, 75, None, 95), (5, 80, None, 100), (4, 85, None, 100), (3, 90, None, 100), (2, 95, None, 100), (1, 100, None, 100)),
    "CGC": ((10.5, 50, None, 55), (10, 55, None, 75), (9.5, 55, None, 75), (9, 60, None, 90), (8.5, 62.5, None, 90), (8, 65, None, 90), (7.5, 65, None, 90), (7, 70, None, 90), (6, 75, None, 90), (5, 80, None, 90), (4.5, 85, None, 90), (3.5, 90, None, 95), (1, 100, None, 100)),
    "TAG": ((10.5, 51, None, 52), (10, 55, None, 65), (9, 60, None, 75), (8.5, 62.5, None, 85), (8, 65, None, 95), (7.5, 67.5, None, 97.5), (7, 70, None, 97.5), (6, 75, None, 99), (5, 80, None, 99), (4, 85, None, 100), (3, 90, None, 100), (1, 100, None, 100)),
}
# TAG centering points by share, and condition points by grade.
TAG_CENTERING_POINTS = {
    "front": ((50, 1000), (51, 990), (55, 950), (60, 900), (62.5, 850), (65, 800), (67.5, 750), (70, 700), (75, 600), (80, 500), (85, 400), (90, 300), (95, 200), (100, 100)),
    "back": ((50, 1000), (52, 990), (65, 950), (75, 900), (85, 850), (95, 800), (97.5, 700), (99, 600), (100, 400)),
}
TAG_CONDITION_POINTS = ((1, 120), (1.5, 170), (2, 220), (2.5, 270), (3, 320), (3.5, 370), (4, 420), (4.5, 470), (5, 520), (5.5, 570), (6, 620), (6.5, 670), (7, 720), (7.5, 770), (8, 820), (8.5, 870), (9, 915), (9.5, 940), (10, 965), (10.5, 1000))
TAG_WEAKEST_WEIGHT = 0.85
TAG_SIDE_WEIGHTS = {"front": 0.6, "back": 0.4}
# BGS and CGC combination rules.
MAX_ABOVE_LOWEST, OUTLIER_GAP, OUTLIER_BONUS = 0.5, 2.5, 1.0
