"""The command line from a dialogue file to judged answers and tables."""

import json

from recallspark.__main__ import main, parser


def test_build_ask_evaluate_judge_tables(spark, tmp_path, capsys):
    turns = [{"speaker": s, "dia_id": f"D1:{i}", "text": t} for i, (s, t) in enumerate([("Ann", "I bought a red kayak yesterday."), ("Bo", "Mine is green."), ("Ann", "We go to the lake on Monday.")])]
    qa = [{"question": "What did Ann buy?", "answer": "a red kayak", "evidence": ["D1:0"], "category": 4}, {"question": "Where do they go?", "answer": "the lake", "evidence": ["D1:2"], "category": 2}]
    sample = {"qa": qa, "conversation": {"speaker_a": "Ann", "speaker_b": "Bo", "session_1_date_time": "1:56 pm on 8 May, 2023", "session_1": turns}}
    (tmp_path / "d.json").write_text(json.dumps([sample]))
    layer, out = str(tmp_path / "layer"), str(tmp_path / "run")
    main(["build", layer, str(tmp_path / "d.json")])
    assert spark.read.parquet(f"{layer}/episodes").count() == 3
    few = ["--scan-top-k", "5", "--prf-docs", "0", "--no-rerank"]
    main(["ask", layer, "0", "Which red kayak did Ann get?", "--now", "2023-05-10", *few])
    assert "kayak" in capsys.readouterr().out
    main(["evaluate", layer, str(tmp_path / "d.json"), out, *few])
    shown = capsys.readouterr().out
    assert "overall" in shown and "temporal" in shown
    rows = spark.read.json(f"{out}/per_question")
    assert rows.count() == 2 and "top_k" in spark.read.text(f"{out}/config").first().value
    main(["tables", f"{out}/per_question"])
    assert "single_hop" in capsys.readouterr().out
    main(["judge", f"{out}/per_question", "--cache", str(tmp_path / "cache")])
    judged = spark.read.json(f"{out}/per_question.j2.json").collect()
    assert len(judged) == 2 and spark.read.parquet(str(tmp_path / "cache")).count() <= 2


def test_arguments():
    a = parser().parse_args(["evaluate", "l", "d", "o", "--fusion", "rrf", "--no-multimodal", "--context-window", "2"])
    assert (a.fusion, a.multimodal, a.context_window, a.rerank) == ("rrf", False, 2, True)
