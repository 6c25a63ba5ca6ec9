"""Declarations of eleven languages: what is found, where, under which name, and what errors cost."""

import pytest

from hayrick.sources.lexer import tokens
from hayrick.sources import symbols
from hayrick.sources.symbols import parse_source

CASES = [
    ("c", "int add(int a, int b) { return a + b; }\n", ["function add 1-1"]),
    ("c", "#define F(x) \\\n  { x\nstatic struct node *make(struct node *n, int (*cb)(int))\n{\n  for (;;) { }\n}\nint table[] = { 1 };\nstruct s { int a; } one;\nint (*pick(int x))(int) { return 0; }\n", ["function make 3-6", "struct make.node 3-3", "struct make.node 3-3", "struct s 8-8", "function pick 9-9"]),
    ("cpp", "struct Point { int x; };\nclass Engine { public: void start(); };\nvoid Engine::start() { run(); }\n", ["struct Point 1-1", "class Engine 2-2", "function Engine::start 3-3"]),
    ("cpp", 'namespace a::b {\ntemplate <class T>\nclass Foo final : public Bar<T> {\n public:\n  Foo() : x_(1), y_{2} { }\n  explicit Foo(int x);\n  ~Foo() { }\n  char get(int i) const override { return R"(})"[0]; }\n  Foo(const Foo&) = delete;\n  enum class Kind { A };\n};\ntemplate <typename T> int Foo<T>::get(int i) const { return 1; }\nFoo::~Foo() { }\nextern "C" { void plain(void) { } }\n}\nstd::vector<int> v(std::map<int, int> m) { return {}; }\nauto f() -> int { return 1; }\nclass Fwd;\n', ["class Foo 3-11", "function Foo.Foo 5-5", "function Foo.get 8-8", "function Foo.Foo 9-9", "function Foo<T>::get 12-12", "function Foo::~Foo 13-13", "function plain 14-14", "function v 16-16", "function f 17-17", "class Fwd 18-18"]),
    ("java", 'class A<T extends C<T>> extends B {\n  private Map<String, List<Integer>> m = new HashMap<>();\n  public A(int x) { }\n  @Override\n  @SuppressWarnings({"a", "b"})\n  public <R extends F> Map<String, R> go(\n      final int a,\n      List<? super R> b) throws E {\n    Runnable r = new Runnable() { public void run() { } };\n    return null;\n  }\n  abstract int[] arr();\n  enum Color { RED { int v() { return 1; } }, GREEN(2); int v() { return 0; } }\n  interface Inner { default void d() {} }\n}\n', ["class A 1-15", "method A.go 4-11", "method A.go.run 9-9", "method A.arr 12-12", "enum A.Color 13-13", "method A.Color.v 13-13", "method A.Color.v 13-13", "interface A.Inner 14-14", "method A.Inner.d 14-14"]),
    ("csharp", 'namespace X {\n  [Attr(1)]\n  public sealed class A : B<int> where T : new() {\n    public A() : base(1) { }\n    async Task<List<int>> Go<T>(int a, (int, string) t) where T : class { var x = $"{a}"; Foo(a); }\n    int Twice(int x) => 2 * x;\n    void IFoo.Bar() { }\n    public string Name { get; set; }\n    public static bool operator ==(A a, A b) { return true; }\n    int? N() { return null; }\n  }\n  struct P { int X; }\n  interface I { void M(); }\n}\n', ["class A 2-11", "method A.Go 5-5", "method A.Twice 6-6", "method A.Bar 7-7", "method A.N 10-10", "struct P 12-12", "interface I 13-13", "method I.M 13-13"]),
    ("javascript", "class A {\n  bar(\n    a,\n  ) {\n    if (a) { return `x ${b ? `}` : '{'} y`; }\n  }\n  static async *gen() {}\n  get size() { return 1 }\n  #p() {}\n  [Symbol.iterator]() { return /[}/]/g; }\n}\nconst o = { run() {}, 'a b'(x) { } };\nexport default async function go() {}\nfunction* g() {}\nconst f = function named() {};\n", ["class A 1-11", "method A.bar 2-6", "method A.gen 7-7", "method A.size 8-8", "method A.#p 9-9", "method A.[Symbol.iterator] 10-10", "method run 12-12", "method 'a b' 12-12", "function go 13-13"]),
    ("typescript", "interface Opts { a: number }\ntype Alias = string\nexport class B<T extends {a: number}> extends C<{b: 1}> {\n  constructor(private x: number) { super() }\n  m<T>(a: T): { a: T } { return {a}; }\n  n(): Promise<{a: string}> {\n  }\n  later(): void;\n}\nconst enum E { A = 1 }\ntype U<T> =\n  | { k: T }\n  | string;\nfunction over(a: string): void;\nfunction over(a: any) {}\n", ["interface Opts 1-1", "type_alias Alias 2-2", "class B 3-9", "method B.constructor 4-4", "method B.m 5-5", "method B.n 6-7", "enum E 10-10", "type_alias U 11-13", "function over 15-15"]),
    ("tsx", "function App() {\n  return <div onClick={() => { go(); }}>it's {x}</div>;\n}\n", ["function App 1-3"]),
    ("go", "package p\ntype Point struct { X int }\ntype Reader interface { Read() }\nfunc (r *R[T]) M(a struct{ x int }) (int, error) {\n\tgo func() { }()\n}\nfunc G[T any](x T) interface{ Foo() } {\n\treturn nil\n}\ntype (\n\tA struct {\n\t\tx int\n\t}\n\tC func(int) error\n)\nvar s = `func Fake() {`\n", ["struct Point 2-2", "interface Reader 3-3", "method M 4-6", "function G 7-9", "struct A 11-13", "type_alias C 14-14"]),
    ("rust", "#[derive(Debug)]\npub struct P<T: Foo> { a: T }\nstruct U(i32, String);\nimpl<T> fmt::Display for P {\n  fn fmt(&self) -> Result<(), E> { write!(f, \"{}\", self.a) }\n}\npub(crate) async unsafe fn go<'a, F>(x: &'a str) -> impl Fn(i32) where F: Fn() -> X { let c = '{'; fn inner() {} r#\"}\"#; }\ntrait T { fn sig(&self); fn dflt(&self) {} }\nenum E { A, B { x: i32 } }\nimpl<T> Vec2<T> { fn n() {} }\n/* a /* nested */ fn no() {} */\nmacro_rules! m { () => { fn fake() {} } }\n", ["struct P 2-2", "struct U 3-3", "impl P 4-6", "function P.fmt 5-5", "function go 7-7", "function go.inner 7-7", "trait T 8-8", "function T.dflt 8-8", "enum E 9-9", "function n 10-10"]),
    ("ruby", "class Greeter\n  def greet\n  end\nend\n", ["class Greeter 1-4", "method Greeter.greet 2-3"]),
    ("ruby", "module M\n  class A < B::C\n    def initialize(x)\n      @x = x if x\n      y = if x then 1 else 2 end\n      [1].each do |i| puts \"#{i > 1 ? \"end\" : 'x'}\" end\n      while x do x = false end\n    end\n    def self.make = new(1)\n    def x=(v)\n      sql = <<~SQL\n        def fake\n      SQL\n    end\n    def ==(o) ; true; end\n  end\nend\nclass A::B; end\n", ["module M 1-17", "class M.A 2-16", "method M.A.initialize 3-8", "method M.A.make 9-9", "method M.A.x= 10-14", "method M.A.== 15-15", "class A::B 18-18"]),
    ("php", "<html><?php\nabstract class B extends C {\n  public function __construct(private int $x) { }\n  abstract protected function f(): ?string;\n  public static function &g(array $a = []): self { $h = function() { }; return new class { function m() {} }; }\n}\nenum S: string { case A = 'a'; public function label(): string { return \"x {$y['a']}\"; } }\nfunction top($a) { echo <<<EOT\nfunction fake() {\nEOT;\n}\n?>\n", ["class B 2-6", "method B.__construct 3-3", "method B.f 4-4", "method B.g 5-5", "method B.g.m 5-5", "enum S 7-7", "method S.label 7-7", "function top 8-11"]),
]


@pytest.mark.parametrize(("lang", "source", "expected"), CASES)
def test_what_is_declared(lang, source, expected):
    found, status, detail = parse_source(source.encode(), lang)
    assert (status, detail) == ("ok", None)
    assert [f"{s['kind']} {s['qualname']} {s['line']}-{s['end_line']}" for s in found] == expected


@pytest.mark.parametrize(
    ("lang", "source", "names", "status"),
    [
        ("rust", "fn main( {\n", [], "error"),
        ("rust", "struct A;\nfn main( {\n", ["A"], "partial"),
        ("java", "class A {\n  void ok() { }\n  void bad( {\n  void after() { }\n}\n", ["A", "A.ok"], "partial"),
        ("c", "int f(void) { return (1; }\nint g(void) { return 2; }\n", ["f", "g"], "partial"),
        ("ruby", "def a\n  if x\nend\n", [], "error"),
        ("go", "package p\n", [], "empty"),
        ("javascript", "function a() { return [1, 2; }\nfunction b() {}\n", ["a", "b"], "partial"),
        ("cpp", "", [], "empty"),
    ],
)
def test_what_errors_cost(lang, source, names, status):
    found, state, detail = parse_source(source.encode(), lang)
    assert set(names) <= {s["qualname"] for s in found} and state == status and (detail is None) == (status == "empty")


def test_heads_go_up_to_the_body():
    (f,) = parse_source(b"static int\nadd(int a,\n    int b)\n{\n  return a;\n}\n", "c")[0]
    assert (f["signature"], f["full_signature"], f["line"], f["end_line"]) == ("static int", "static int\nadd(int a,\n    int b)", 1, 6)
    (s,) = parse_source(b"type Server struct {\n\tName string\n}\n", "go")[0]
    assert s["full_signature"] == s["signature"] == "Server struct {" and s["body"].startswith("type Server")


def test_tokens():
    t = tokens("a `x ${ {b: `}`} } y` /[/}]/ 'it\\'s' // }\n/* { */ c", "javascript")
    assert t.values[:2] == ["a", "`x ${ {b: `}`} } y`"] and t.values[-2:] == ["'it\\'s'", "c"]
    assert tokens("x = <<~A + <<~B\n  {\n  A\n  }\n  B\ny", "ruby").values == ["x", "=", "<<~A", "+", "<<~B", "y"]
    assert tokens('let s = r##"a"# }"##; \'a\' \'{\'', "rust").values == ["let", "s", "=", 'r##"a"# }"##', ";", "'a'", "'{'"]
    assert tokens("(]", "go").wrong and not tokens("([{}])", "go").wrong
    assert tokens("`never ends ${", "javascript").values == ["`never ends ${"]


def test_files_of_one_split_are_dealt_to_all_cores(spark):
    files = spark.range(0, 40, 1, 1).selectExpr("concat('f', id, '.py') as path", "cast('def f():\n  pass\n' as binary) as content")
    found = symbols.parse(files)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert found.where("qualname = 'f'").count() == 40
