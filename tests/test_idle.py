"""Idle consolidation: windows, refusals with reasons, repeated runs and promotion into a library's versions."""

import pytest
from pyspark.sql import functions as F

from engram.operators import idle
from engram.sources import store

ENTRY = "memory_id long, text string, source string, ts double, tags array<string>, superseded_by long"
ROWS = [
    (1, "the harbour office moved to pier nine in march", "hook", 1000.0, ["comp:port"], None),
    (2, "boats are counted every tuesday at the north gate", "model", 1100.0, [], None),
    (3, "invoices go to the second floor of the annex", "hook", 1200.0, ["comp:office"], None),
    (4, "boats were counted on mondays at the north gate", "hook", 1050.0, None, 2),
    (5, "short one", "hook", 1300.0, ["comp:port"], None),
    (6, "an old note about the lighthouse and its keeper", "hook", 10.0, ["comp:port"], None),
    (7, None, "hook", 1250.0, ["comp:port"], None),
]


class Inventing(idle.StubJudge):
    def distill(self, turns):
        return F.array(F.lit("boats are counted at the north gate"), F.lit("boats sink every friday at the gate"), F.lit("the token is hf_abcdef for the gate"), F.lit("— — —"), F.lit(" "), F.lit("boats are counted at the north gate"))


@pytest.fixture
def entries(spark):
    return spark.createDataFrame(ROWS, ENTRY)


def test_window_and_turns(entries):
    ids = lambda df: sorted(r.memory_id for r in df.collect())
    assert ids(idle.window(entries, 1300.0, 10)) == [1, 2, 3, 5, 7]
    assert ids(idle.window(entries, 1300.0, 10, "port")) == [1, 2, 5, 7]
    told = idle.turns(idle.window(entries, 1300.0, 10, "port")).first().turns
    assert told == ["hook: the harbour office moved to pier nine in march", "model: boats are counted every tuesday at the north gate", "hook: ", "hook: short one"]
    cut = idle.turns(idle.window(entries, 1300.0, 10, "port"), 70).first().turns
    assert cut == ["hook: the harbour office moved to pier nine in march", "model: boats are "]
    assert idle.turns(entries.filter("false")).collect() == []


def test_proposals_carry_reasons(entries):
    got = {r.text: (r.status, r.note) for r in idle.propose(entries, 1300.0, Inventing(), minutes=10, compartment="port").collect()}
    assert got == {
        "boats are counted at the north gate": ("proposed", ""),
        "boats sink every friday at the gate": ("refused", "unsupported: friday; sink"),
        "the token is hf_abcdef for the gate": ("refused", "credential"),
        "— — —": ("refused", "junk"),
    }
    assert idle.propose(entries, 1300.0, min_turns=5, minutes=10, compartment="port").count() == 0


def test_a_second_run_changes_nothing(spark, entries, tmp_path):
    lib = store.Library(spark, f"{tmp_path}/lib")
    first, _ = lib.save(entries)
    made = idle.propose(entries, 1300.0, minutes=10, compartment="port")
    assert sorted(r.text for r in made.collect()) == [ROWS[1][1], ROWS[0][1]]
    assert idle.propose(entries, 1300.0, known=made, minutes=10, compartment="port").count() == 0
    # What the library says already isn't stored again.
    version, current, done = idle.promote(lib, made, 2000.0)
    assert (version, current) == (first, True) and {r.fate for r in done.collect()} == {"known"}
    told = idle.propose(entries, 1300.0, Inventing(), minutes=10, compartment="port").withColumn("text", F.when(F.col("status") == "proposed", "counting boats happens by the gate, on the north side").otherwise(F.col("text")))
    version, current, done = idle.promote(lib, told, 2000.0)
    assert current and version != first and [r.fate for r in done.collect()] == ["stored"]
    new = lib.load().filter("memory_id > 7").collect()
    assert [(r.memory_id, r.source, r.ts, sorted(r.tags)[:2]) for r in new] == [(8, "model", 2000.0, ["comp:port", "consolidation"])]
    again = idle.promote(lib, told, 3000.0)
    assert again[0] == version and {r.fate for r in again[2].collect()} == {"known"} and lib.load().count() == 8


def test_a_writer_in_between_makes_a_conflict(spark, entries, tmp_path):
    lib = store.Library(spark, f"{tmp_path}/lib")
    lib.save(entries)
    told = spark.createDataFrame([("p1", None, "ferries leave when the bell rings twice", "proposed", "")], "proposal_id string, compartment string, text string, status string, note string")
    loaded = lib.load

    def slow(version=None):
        df = loaded(version)
        if version is not None:
            lib.save(entries.filter("memory_id < 3"), version)
        return df

    lib.load = slow
    version, current, _ = idle.promote(lib, told, 2000.0)
    assert not current and version.startswith("conflict-") and loaded().count() == 2
