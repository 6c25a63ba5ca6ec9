import math

import pytest

from hayrick import models
from hayrick.errors import HayrickError
from hayrick.plans import evaluation
from hayrick.sources.symbols import parse


class Fake(models.Endpoint):
    replies: list = []
    asked: list = []

    def post(self, path, body):
        self.asked.append((path, body))
        reply = self.replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply


@pytest.fixture
def endpoint():
    Fake.replies, Fake.asked = [], []
    return Fake("http://nowhere")


def test_embedding_in_batches_and_order(endpoint):
    batch = lambda n: {"data": [{"index": i, "embedding": [float(i), 1.0]} for i in reversed(range(n))]}
    Fake.replies = [batch(32), batch(3)]
    found, warning = models.embed([str(i) for i in range(35)], False, endpoint=endpoint, dim=2)
    assert warning is None and [v[0] for v in found] == [*map(float, range(32)), 0.0, 1.0, 2.0]
    Fake.replies = [batch(1)]
    assert models.embed(["x"], True, endpoint=endpoint, dim=3)[0] is None
    Fake.replies = [OSError("down")]
    assert models.embed(["x"], True, endpoint=endpoint, dim=2) == (None, "embedding failed: down")
    Fake.replies = [batch(1)]
    models.embed(["x"], True, endpoint=endpoint, dim=2, instructions=("t", "q"), normalize=True)
    assert Fake.asked[-1][1]["input"] == ["Instruct: q\nQuery: x"]
    assert models.unit([3.0, 4.0]) == [0.6, 0.8] and models.unit([0.0]) == [0.0]


def test_expansion(endpoint):
    say = lambda text: {"choices": [{"message": {"content": text}}]}
    Fake.replies = [say('```json\n["a", " b ", "", 3]\n```'), say("no"), say("{}"), OSError()]
    got = [models.expand("q", endpoint=endpoint, prompt="p") for _ in range(4)]
    assert got == [["a", "b", "3"], [], [], []]


def test_reranking(endpoint):
    Fake.replies = [{"results": [{"index": 1, "relevance_score": 0.9}, {"index": 0, "score": "0.1"}, {"index": "x"}, 5, {"index": True, "score": 1}, {"index": 1}]}, {"results": []}]
    assert models.rerank("q", ["a", "b"], endpoint=endpoint) == ([(1, 0.9), (0, 0.1)], "4 of the reranker's 6 items were malformed")
    assert models.rerank("q", ["a"], endpoint=endpoint)[0] is None
    lp = lambda **k: {"completion_probabilities": [{"top_logprobs": [{"token": t, "logprob": p} for t, p in k.items()]}]}
    Fake.replies = [lp(yes=-3.0, no=-0.1), lp(yes=-0.1, maybe=-4.0)]
    order, _ = models.rerank_by_completion("q{document}", ["a", "b"], endpoint=endpoint, template="{query}|{document}")
    assert [i for i, _ in order] == [1, 0] and order[0][1] > 0.97
    assert Fake.asked[-1][1]["prompt"] == "q{document}|b"
    Fake.replies = [lp(maybe=-1.0)]
    assert models.rerank_by_completion("q", ["a"], endpoint=endpoint, template="")[0] is None


def test_deadlines():
    late = models.Endpoint("http://nowhere", until=-math.inf)
    assert models.rerank("q", ["a"], endpoint=late)[1] == "reranking failed: the deadline has passed"
    assert models.Models().callables() == {"embed": None, "expand": None, "rerank": None}


def test_bodies_from_a_snapshot(spark):
    files = spark.createDataFrame([("a.py", b"def f():\n    return 1\n")], "path string, content binary")
    pools = spark.createDataFrame([("q", 1, "a.py", "f", 1)], "qid string, rank int, path string, qualname string, line int")
    assert evaluation.attach_bodies(pools, parse(files)).first()["body"] == "def f():\n    return 1"
    with pytest.raises(HayrickError):
        evaluation.attach_bodies(pools.selectExpr("qid", "rank", "path", "'g' as qualname", "line"), parse(files))
