import os
import subprocess
import sys

import __spark_entry__ as e

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_registry(spark):
    df = e.entry(spark)
    rows = df.collect()
    assert {r.zone for r in rows} <= {"Undertraining", "Optimal Zone", "Caution", "Danger Zone"}
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 90


def test_survey_ids_covered():
    ids = set()
    for name in e.queries():
        for part in name.split("_"):
            if part[:1].isalpha() and part[1:].isdigit():
                ids.add(part.upper())
    for must in ["S1", "S2", "S3", "S4", "S5", "S6", "S9", "S10", "F1", "F2", "F3", "F5", "F6", "F7", "F8", "F10",
                 "F11", "F15", "J1", "J2", "J4", "J7", "J8", "A1", "A2", "A3", "A4", "A5", "A6", "A7", "A8", "A9",
                 "A10", "A11", "A12", "A13", "A14", "A15", "A16", "A17", "W1", "W2", "W3", "W4", "W5", "W6", "W7",
                 "W8", "W9", "W10", "W11", "T2", "T3", "T6", "E1", "E2", "E3", "E4", "E5", "E6", "E7", "E8", "E9",
                 "E10", "E11", "E12", "E13", "E14", "E16", "E17", "E18", "E19", "R1", "R2", "R3", "R4", "R5", "R6", "R7", "R8", "R9",
                 "C1", "C2", "C3", "C4", "C5", "C6", "L1", "L3", "L6", "L7", "L8", "L9", "L10", "L11", "L12", "L13",
                 "M1", "M2", "M3", "M4", "M5", "M6", "M7", "M8", "M9", "M10", "X1", "X2", "X3", "P1", "P2", "P3",
                 "G1", "G2", "G3", "G4", "G5", "G6", "G7", "Q1", "Q2", "Q3", "Q4", "Q5", "Q6"]:
        assert must in ids, must


def test_entry_stands_without_the_libraries_of_the_training_data_operators():
    code = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {blocked!r}:
            raise ImportError(name)
sys.meta_path.insert(0, Missing())
sys.path.insert(0, {root!r})
import __spark_entry__ as e
assert len(e.queries()) >= 110 and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    for blocked in (["regex"], ["corpus_pipeline"]):
        subprocess.run([sys.executable, "-c", code.format(blocked=blocked, root=ROOT)], check=True, cwd="/")
