from claimloom.operators import authority, verify


def test_exclusions_join_flags_once_and_speak_for_themselves(spark):
    verdicts = spark.createDataFrame(
        [(1, ["narrow_support"], "OVERSTATED", 0.4, ["r"], "fix"), (2, ["missing_citation"], "UNSUPPORTED", 0.75, ["r"], "fix"), (3, [], "SUPPORTED", 0.85, ["r"], None), (4, ["x"], "SUPPORTED", 0.85, ["r"], None)],
        "claim_id long, flags array<string>, verdict string, confidence double, reasoning array<string>, suggested_fix string",
    )
    links = [(1, 5, "b_code"), (1, 2, "z_code"), (1, 9, "b_code"), (1, 7, "narrow_support"), (2, None, "b_code"), (3, 1, None), (3, 1, None), (9, 1, "b_code")]
    rows = {r["claim_id"]: r for r in verify.with_exclusions(verdicts, spark.createDataFrame(links, "claim_id long, link_order long, code string")).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert rows[1]["flags"] == ["narrow_support", "z_code", "b_code"] and rows[1]["suggested_fix"] == "fix" and rows[1]["reasoning"] == ["r"]
    assert rows[1]["exclusion_note"] == "Excluded 4 invalid support link(s) from reasoning: 2 b code, 1 narrow support, 1 z code."
    assert rows[2]["reasoning"] == [verify.NONE_REMAIN[0]] and rows[2]["suggested_fix"] == verify.NONE_REMAIN[1]
    assert rows[3]["flags"] == [] and rows[3]["suggested_fix"] == verify.SOME_INVALID
    assert rows[3]["exclusion_note"] == "Excluded 2 invalid support link(s) from reasoning: 2 invalid support link."
    assert rows[4]["exclusion_note"] is None and rows[4]["suggested_fix"] is None


def test_reasons_come_in_the_flags_order_and_the_first_fix_counts(spark):
    rows = spark.createDataFrame(
        [(["needs_human_review", "narrow_support"], 0, False, "OVERSTATED"), ([], 0, False, "SUPPORTED"), ([], 0, True, "AMBIGUOUS"), (["invalid_anchor", "subject_mismatch"], 3, True, "AMBIGUOUS")],
        "flags array<string>, n long, weak boolean, verdict string",
    )
    said = {f: s for f, s, _ in verify.SAID}
    got = [tuple(r) for r in rows.select(verify.reasoning_of(rows["flags"], rows["n"], rows["weak"], rows["verdict"]), verify.fix_of(rows["flags"], rows["weak"])).collect()]
    fixes = {f: x for f, _, x in verify.SAID}
    assert got == [
        ([said["needs_human_review"], said["narrow_support"], verify.OF_VERDICT["OVERSTATED"]], fixes["narrow_support"]),
        ([verify.NO_FLAGS, verify.OF_VERDICT["SUPPORTED"]], None),
        ([verify.NO_FLAGS, verify.ALL_WEAK[0]], verify.ALL_WEAK[1]),
        (["3 linked segment(s) are missing usable provenance anchors.", said["subject_mismatch"], verify.ALL_WEAK[0]], fixes["invalid_anchor"]),
    ]


def test_precedence_of_record_text_and_run(spark):
    cites = spark.createDataFrame(
        [(1, 1, True, 7, "A v. B", "a|1"), (2, 1, False, 7, "A v. B", "a|1"), (3, 1, False, None, "A v. B", "a|1"), (4, 2, False, None, "A v. B", "a"), (5, 2, True, None, None, None), (6, 1, False, 7, "A v. B", "a|1"), (7, 1, False, 7, "A v. B", "a|1")],
        "cite_id long, claim_id long, linked boolean, authority_id long, case_name string, reference string",
    )
    checked = spark.createDataFrame(
        [(1, "available", "UNSUPPORTED", 0.74), (2, "support_verified", "SUPPORTED", 0.86), (3, "not_applicable", None, None), (6, "unavailable", None, 0.55), (7, "available", "AMBIGUOUS", 0.4)],
        "cite_id long, status string, verdict string, confidence double",
    )
    runs = spark.createDataFrame([(1, "OVERSTATED", "run", ["g"], 0.5, "mend")], "claim_id long, verdict string, reasoning string, categories array<string>, confidence double, suggested_fix string")
    lookups = spark.createDataFrame([(2, "authority_not_found", None), (3, "authority_found", "ext"), (6, "lookup_not_attempted", "none")], "cite_id long, lookup_status string, found_id string")
    rows = {r["cite_id"]: r for r in authority.effective(cites, authority.explained(checked), runs, lookups).collect()}
    of = lambda *names: {k: tuple(r[n] for n in names) for k, r in rows.items()}
    assert of("authority_id", "authority_status", "match_status") == {
        1: ("7", "linked_authority_support_present", "matched"), 2: (None, "authority_candidate_parsed", "authority_not_found"), 3: ("ext", "authority_matched", "authority_found"),
        4: (None, "citation_recognized", "recognized_only"), 5: (None, "linked_authority_support_present", "not_reviewed"), 6: ("7", "authority_matched", "matched"), 7: ("7", "authority_matched", "matched"),
    }
    said = authority.OUTCOMES
    assert of("verdict", "reasoning", "categories", "confidence", "suggested_fix") == {
        1: ("OVERSTATED", "run", ["g"], 0.5, "mend"), 2: ("SUPPORTED", said["supported"][0], [], 0.86, "mend"), 3: ("OVERSTATED", "run", ["g"], 0.5, "mend"),
        4: ("UNVERIFIED", None, [], None, None), 5: ("UNVERIFIED", None, [], None, None), 6: ("OVERSTATED", said["unavailable"][0], ["weak_support"], 0.55, said["unavailable"][2]),
        7: ("AMBIGUOUS", said["thin"][0], ["weak_support"], 0.4, said["thin"][2]),
    }


def test_propositions_meet_their_authority_s_text_without_being_gathered(spark):
    """Excerpts out of order and ties; the columns asked for stay; nothing is grouped by proposition."""
    mine = spark.createDataFrame(
        [(1, "Gates opened slowly", 7, "x"), (2, "gates must open", 7, "y"), (3, "", 7, "z"), (4, "gates", 8, "u"), (5, "gates", None, "v"), (6, "nothing alike", 7, None)],
        "cite_id long, core string, authority_id long, note string",
    )
    excerpts = spark.createDataFrame([(7, 1, "gates opened"), (7, 0, "mills and gates"), (9, 0, "gates")], "authority_id long, place int, excerpt string")
    found = authority.content_verdicts(mine, excerpts, ("note",))
    got = {r["cite_id"]: (r["overlap"], r["status"], r["verdict"], r["excerpt"], r["note"]) for r in found.collect()}
    assert got == {
        1: (0.666667, "support_verified", "SUPPORTED", "gates opened", "x"), 2: (0.333333, "available", "OVERSTATED", "mills and gates", "y"),
        3: (0.0, "available", "AMBIGUOUS", "mills and gates", "z"), 4: (0.0, "unavailable", None, None, "u"), 5: (0.0, "not_applicable", None, None, "v"),
        6: (0.0, "available", "UNSUPPORTED", "mills and gates", None),
    }
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
