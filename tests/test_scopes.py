"""Symbols and references with their scopes, against what a reader would write down."""

import time

import pytest

from graphweft.operators import scopes

SOURCES = {}

SOURCES["typescript"]="""import { a, b } from './lib';
const x = require("fs"); // class No {}
/* function no() { */
export class Box<T> extends Base.Kind implements Shape {
  constructor(private a: number) { super(a); }
  run(a: string): Promise<void> {
    if (a) { this.walk("}{"); }
    return /[}]"/.test(a) ? helper(a.go()) : `x ${a} }`;
  }
  walk = 3;
}
const arrow = async (a) => {
  function inner() { deep(); }
  inner();
};
namespace N { export function f() { g(); } }
"""
SOURCES["java"]="""package p;
import static a.b.C;
import java.util.List;
public class Outer extends Base<String> implements One, x.Two {
    private int n = make();
    Outer(int a) { init(a); }
    static class Inner {
        void run() throws E { this.go(1); list.add("}"); }
    }
    enum Kind { A, B; int of() { return size(); } }
    public List<String> all(int a) { return new ArrayList<>(a); }
}
"""
SOURCES["go"]="""package m
import (
	"fmt"
	x "net/http"
)
type Box struct { n int }
func (b *Box) Run(a int) error {
	fmt.Println("}", 'x')
	go func() { deep() }()
	return helper(a)
}
func TestBox(t *testing.T) { Make() }
"""
SOURCES["rust"]="""use std::io::{Read, Write};
use a::b;
pub struct Box<'a> { n: &'a str }
struct Unit;
trait Shape { fn area(&self) -> f64; }
impl<'a> Shape for Box<'a> {
    fn area(&self) -> f64 { self.side('}') * helper("{") }
}
mod inner { pub fn f() { g(); } }
"""
SOURCES["cpp"]="""#include <vector>
#include "a/b.h"
#define M(x) { x
namespace n {
class Box final : public Base, private ns::Other {
 public:
  Box(int a) : a_(a) { init(); }
  int run() const override { return this->side() + helper('{'); }
  void later();
};
}
int Box::side(int a) { return call(a); }
static int g = compute();
int main(int argc) { Box b; if (argc) { b.run(); } }
"""
SOURCES["ruby"]="""require 'set'
module M
  class Box < Base
    def run(a)
      return helper(a) if a
      [1].each do |x|
        self.walk(x)
      end
      while a do go(a) end
    end
    def self.make?; end
  end
end
"""
SOURCES["php"]="""<?php
use A\\B;
class Box extends Base implements One {
  public function run($a) { # }
    $this->walk($a); return helper('}');
  }
}
function f() { g(); }
"""

NODES = {
    "typescript": "Class Box 4-11, Method Box.constructor 5-5, Method Box.run 6-9, Function arrow 12-15, Function arrow.inner 13-13, Module N 16-16, Function N.f 16-16",
    "java": "Class Outer 4-12, Method Outer.Outer 6-6, Class Outer.Inner 7-9, Method Outer.Inner.run 8-8, Type Outer.Kind 10-10, Method Outer.Kind.of 10-10, Method Outer.all 11-11",
    "go": "Class Box 6-6, Method Box.Run 7-11, Test TestBox 12-12",
    "rust": "Class Box 3-3, Class Unit 4-4, Interface Shape 5-5, Method Shape.area 5-5, Method Box.area 7-7, Module inner 9-9, Function inner.f 9-9",
    "cpp": "Module n 4-11, Class n.Box 5-10, Method n.Box.Box 7-7, Method n.Box.run 8-8, Method Box.side 12-12, Function main 14-14",
    "ruby": "Module M 2-13, Class M.Box 3-12, Method M.Box.run 4-10, Method M.Box.make? 11-11",
    "php": "Class Box 3-7, Method Box.run 4-6, Function f 8-8",
}
REFERENCES = {
    "typescript": "IMPORTS ./lib, IMPORTS fs, EXTENDS Base.Kind, EXTENDS Shape, CALLS Box.walk, CALLS test, CALLS helper, CALLS go, CALLS deep, CALLS inner, CALLS g",
    "java": "IMPORTS a.b.C, IMPORTS java.util.List, EXTENDS Base, EXTENDS One, EXTENDS x.Two, CALLS init, CALLS Inner.go, CALLS add, CALLS size",
    "go": "IMPORTS fmt, IMPORTS net/http, CALLS Println, CALLS deep, CALLS helper, TESTS Make",
    "rust": "IMPORTS std::io, IMPORTS a::b, EXTENDS Shape, CALLS Box.side, CALLS helper, CALLS g",
    "cpp": "IMPORTS vector, IMPORTS a/b.h, EXTENDS Base, EXTENDS ns.Other, CALLS init, CALLS Box.side, CALLS helper, CALLS call, CALLS compute, CALLS run",
    "ruby": "IMPORTS set, EXTENDS Base, CALLS helper, CALLS Box.walk, CALLS go",
    "php": "IMPORTS A\\B, EXTENDS Base, EXTENDS One, CALLS Box.walk, CALLS helper, CALLS g",
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"src/{k}.x", k, text) for k, text in SOURCES.items()] + [("e.go", "go", ""), ("n.go", "go", None), ("p.py", "python", "def f(): g()"), ("o.java", "java", "class A { void f() { g(")]
    nodes, refs = scopes.scoped_symbols(spark.createDataFrame(rows, "file_path string, language string, content string"))
    return nodes.orderBy("start_line", "qname").collect(), refs.collect()


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_scopes_are_those_of_a_reader(found, language):
    nodes, refs = found
    own = [n for n in nodes if n.language == language and n.file_path.startswith("src/")]
    assert sorted(f"{n.type} {n.qname.removeprefix(f'src.{language}.')} {n.start_line}-{n.end_line}" for n in own) == sorted(NODES[language].split(", "))
    assert sorted(f"{r.relation} {r.target}" for r in refs if r.source_file == f"src/{language}.x") == sorted(REFERENCES[language].split(", "))


def test_calls_and_owners_name_their_scopes(found):
    nodes, refs = found
    named = {n.id: n.qname for n in nodes}
    assert {named[r.from_id] for r in refs if r.target == "deep"} == {"src.typescript.arrow.inner", "src.go.Box.Run"}
    assert {named[n.owner] for n in nodes if n.qname in ("src.rust.Box.area", "src.go.Box.Run")} == {"src.rust.Box", "src.go.Box"}


def test_open_brackets_close_with_the_file(found):
    nodes, refs = found
    assert {n.qname for n in nodes if n.file_path == "o.java"} == {"o.A", "o.A.f"} and [r.target for r in refs if r.source_file == "o.java"] == ["g"]
    assert not [n for n in nodes if n.file_path in ("e.go", "n.go", "p.py")]


def test_odd_texts_take_time_in_proportion():
    def took(text, language):
        began = time.process_time()
        scopes.scanned("a", language, text, "m")
        return time.process_time() - began

    for piece in ("{", "a(", "f() ", "/*", '"', "class A ", "class A { f() ", "import ", "use ", "struct A : "):
        for language in ("cpp", "typescript", "rust", "ruby"):
            assert took(piece * 12_000, language) < 1 + 4 * took(piece * 6_000, language), (piece, language)
