"""List-valued functions and codecs on single values."""

from sylva.model import elem
from sylva.operators import arrows as A
from sylva.operators import codec as K


def test_node_without_children():
    n = elem("a", {"x": "1"}, "t", elem("b"))
    assert A.get_node(n)[0].children == [] and A.get_node(n)[0].attrs == {"x": "1"}
    changed = A.change_node(lambda m: elem("c", m.attrs))(n)[0]
    assert (changed.name, len(changed.children)) == ("c", 2)
    assert A.set_node(elem("z"))(n)[0].name == "z"
    assert A.has_node(lambda m: m.name == "a")(n) == [n]


def test_lists_and_choices():
    up = A.arr(lambda x: x + 1)
    assert (up + (up >> up))(1) == [2, 3]
    assert A.with_default(A.none, 7)(1) == [7]
    assert A.or_else(A.none, up)(1) == [2]
    assert A.if_a(A.is_a(lambda x: x > 0), up, A.this)(-1) == [-1]
    assert A.choice((A.is_a(lambda x: x > 5), A.const("big")), (A.this, A.const("small")))(3) == ["small"]
    assert A.span(A.is_a(lambda x: x < 3))([1, 2, 3, 1]) == [([1, 2], [3, 1])]
    assert A.partition(A.is_a(lambda x: x < 3))([1, 3, 2]) == [([1, 2], [3])]
    assert A.catch(A.arr(lambda x: 1 / x), A.const("error"))(0) == ["error"]


def test_searches():
    t = elem("r", None, elem("a", None, elem("a", {"k": "1"})), elem("b"))
    assert [len(x.children) for x in A.deep(A.has_name("a"))(t)] == [1]
    assert len(A.multi(A.has_name("a"))(t)) == 2
    assert A.deepest(A.has_name("a"))(t)[0].attrs == {"k": "1"}
    assert [x.name for x in A.process_top_down(A.when(A.none, A.has_name("b")))(t)[0].children] == ["a"]


def test_codec_parts():
    c = K.elem("e", K.add_ns_decl("x", "urn:x", K.record(a=K.attr("k"))))
    assert 'xmlns:x="urn:x"' in K.show(c, {"a": "v"}) and K.read(c, K.show(c, {"a": "v"})) == {"a": "v"}
    assert K.read(K.elem("e", K.ignore_input(K.lift(5))), '<e k="v" z="1"><y/></e>') == 5
    assert K.read(K.elem("e", K.lift_maybe(3)), "<e/>") == 3
