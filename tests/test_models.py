"""Providers: retries, failures, ledger, confidence, captions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallspark import models as M


class Flaky(M.Backend):
    waits = (1, 2)

    def __init__(self, failures, error=OSError):
        self.left, self.error, self.slept = failures, error, []

    def request(self, prompt, images, max_tokens, temperature, logprobs):
        if self.left:
            self.left -= 1
            raise self.error("no")
        return M.Completion("yes", logprobs=[(-0.1, -2.0), (-0.5, None)])


def test_retries_and_refusals():
    f = Flaky(2)
    done = f.call("p", sleep=f.slept.append)
    assert done.ok and done.text == "yes" and f.slept == [1, 2] and done.prompt_tokens == 1
    f = Flaky(3)
    done = f.call("p", sleep=f.slept.append)
    assert (done.text, done.ok, done.transport_failed) == ("", False, True)
    f = Flaky(1, M.ClientError)
    done = f.call("p", sleep=f.slept.append)
    assert not done.ok and not done.transport_failed and f.slept == []
    assert M.Scripted(lambda p: p).call("x" * 40_000).truncated


def test_factory_and_names():
    m = M.make_model("chat", "gpt-4o-mini")
    assert m.window == 128_000 and M.window_of("gpt-4.1-mini") == 1_000_000 and M.window_of("unknown") == 8192
    assert M.is_thinking("qwen3:8b") and not M.is_thinking("gemma3:27b")
    with pytest.raises(ValueError):
        M.make_model("post", "x")
    holder = type("H", (), {"llm": m})()
    assert M.resolve(holder) is m and M.resolve(m) is m and M.resolve(object()) is None
    assert M.shared_by_worker("k", lambda: [1]) is M.shared_by_worker("k", lambda: [2])


def test_calls_ledger_and_confidence(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "boom")], "qid int, prompt string")

    def reply(p):
        if p == "boom":
            raise OSError
        return p.upper()

    done = M.call_column(rows, "prompt", M.Scripted(reply)).persist()
    got = {r.qid: r.call for r in done.collect()}
    assert got[1].text == "A B" and got[2] is None and not got[3].ok and got[3].text == ""
    led = {r.qid: r for r in M.ledger(done, "reader", "m", "qid").collect()}
    assert set(led) == {1, 3} and led[3].transport_failed and led[1].role == "reader"

    class Sure(M.Backend):  # local, so that workers get it by value
        def request(self, prompt, images, max_tokens, temperature, logprobs):
            return M.Completion("yes", logprobs=[(-0.1, -2.0), (-0.5, None)])

    own = M.call_column(rows.where("qid = 1"), "prompt", Sure()).select(M.answer_confidence(F.col("call.logprobs")).alias("c")).first().c
    assert own.lp_mean == pytest.approx(-0.3) and own.n_tokens == 2 and own.lp_margin_mean == pytest.approx(1.9)
    assert done.select(M.answer_confidence(F.col("call.logprobs")).alias("c")).where("c is not null").count() == 0


def test_safe_reranker_meter_and_checks():
    class Bad:
        def score(self, q, p):
            return [float("nan")] * len(p)

    r = M.SafeReranker(Bad())
    assert r.score("q", ["a"]) is None and r.failed
    assert M.SafeReranker(M.OverlapReranker()).score("a", ["a b"]) is not None
    M.check_encoder(M.HashEncoder())
    M.check_reranker(M.OverlapReranker())
    with pytest.raises(M.EncoderFailure):
        M.check_reranker(Bad())
    with pytest.raises(M.EncoderFailure):
        M.final_check(3, 10)
    m = M.Metered(M.HashEncoder())
    assert m.encode(["one text", "two"]).shape == (2, 96) and (m.calls, m.texts) == (1, 2) and m.dim == 96 and np.isfinite(m.seconds)


def test_captions(spark):
    df = spark.createDataFrame([("img/old_red-kayak.jpg",), (None,)], "path string")
    assert [r.caption for r in M.caption_column(df, "path", M.Captioner()).collect()] == ["old red kayak", ""]
    assert M.Captioner(M.Scripted(lambda p: " a  boat ")).caption("x.jpg") == "a boat"
