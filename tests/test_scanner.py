"""Symbols of TypeScript, Go and Rust files."""

from __future__ import annotations

import random

import pytest

from quillstone.operators.code_index import symbols_of

TS = """import { a, b } from "./x";
import fs from 'fs';
// function hidden() { call(); }
export const limit = compute(3);
export class Store extends Base {
  private items = new Map();
  size = count(1);
  constructor(private db: Db) { super(); this.db.open("function fake() { nope(); }"); }
  async get<T>(key: string): Promise<T> {
    const v = this.items.get(key);
    return wrap(v) ?? load(key, () => other(1));
  }
}
export default function main(a: number, b = f(1)) {
  if (a) { helper(`x ${a} {`); }
  return new Store(db).get("k");
}
const arrow = async (x) => {
  inner(x);
};
interface Shape { area(): number; name: string }
"""
GO = """package main
import "fmt"
import (
	"os"
	"strings"
)
type Server struct {
	name string
}
type Handler interface { Serve(x int) error }
var limit = compute(2)
/* func no() {} */
func (s *Server) Run(addr string) error {
	fmt.Println("func x() {")
	go s.loop()
	return nil
}
func main() {
	s := NewServer()
	s.Run("x")
}
"""
RS = """use std::io::{self, Read};
pub struct P<'a> { x: &'a str }
struct Unit;
pub trait T { fn area(&self) -> f64; fn twice(&self) -> f64 { self.area() * 2.0 } }
impl<'a> P<'a> {
    pub fn new(x: &'a str) -> Self { check(x); P { x } }
    fn c(&self) -> char { helper::run('}'); '{' }
}
pub fn main() {
    let p = P::new("fn a() {");
    println!("{}", p.c());
}
static N: u32 = size(4);
"""


def found(file: str, text: str) -> dict:
    return {(s[0], s[1]): s[3:] for s in symbols_of(file, text) if s[1] != "export"}


def test_typescript():
    got = found("a.ts", TS)
    assert set(got) == {
        ('import { a, b } from "./x"', "import"), ("import fs from 'fs'", "import"), ("limit", "variable"), ("Store", "class"), ("constructor", "method"), ("get", "method"),
        ("v", "variable"), ("main", "function"), ("arrow", "variable"), ("Shape", "class"),
    }
    assert got["Store", "class"][:2] == (5, 13) and got["main", "function"] == (14, 17, "(a: number, b = f(1))", ["helper", "get"])
    assert got["get", "method"] == (9, 12, "(key: string)", ["this.items.get", "wrap", "load", "other"]) and got["constructor", "method"][3] == ["this.db.open"]
    assert got["arrow", "variable"] == (18, 20, None, ["inner"]) and got["limit", "variable"][3] == ["compute"]


def test_go():
    got = found("a.go", GO)
    assert set(got) == {('import "fmt"', "import"), ('import ( "os" "strings" )', "import"), ("Server", "class"), ("Handler", "class"), ("limit", "variable"), ("Run", "method"), ("main", "function")}
    assert got["Run", "method"] == (13, 17, "(addr string)", ["fmt.Println", "s.loop"]) and got["main", "function"][3] == ["NewServer", "s.Run"]


def test_rust():
    got = found("a.rs", RS)
    assert {k for _, k in got} == {"import", "class", "method", "function", "variable"} and {n for n, k in got if k == "method"} == {"area", "twice", "new", "c"}
    assert got["twice", "method"][3] == ["self.area"] and got["c", "method"][3] == ["helper::run"] and got["main", "function"] == (9, 12, "()", ["P::new", "p.c"]) and got["N", "variable"][3] == ["size"]


@pytest.mark.parametrize("language", ["ts", "go", "rs"])
def test_any_text_ends(language):
    rng = random.Random(1)
    pieces = ["{", "}", "(", ")", "[", "]", ";", "\n", "class", "struct", "function", "func", "fn", "impl", "export", "default", "import", "use", "type", "const", "let", "x", "y", "=>", "=", ".", "::", "'", '"', "`", "//", "/*", "*/", "<", ",", "*"]
    for _ in range(400):
        text = " ".join(rng.choices(pieces, k=rng.randrange(60)))
        for s in symbols_of(f"a.{language}", text):
            assert 1 <= s[3] <= s[4] <= text.count("\n") + 1


def test_regular_expressions_swallow_no_code():
    text = "const q = /[\"/]/g; function after() { return /'/.test(a) && b / c / d; }\nfunction last() { split(/\\/\"/); }\nconst half = size / 2; function tail() {}"
    names = [s[0] for s in symbols_of("x.ts", text) if s[1] == "function"]
    assert names == ["after", "last", "tail"]
