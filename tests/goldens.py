"""Expressions with the trigram query each is turned into."""

QUERIES = [
    ("Abcdef", "Abc bcd cde def"),
    ("(abc)(def)", "abc bcd cde def"),
    ("abc.*(def|ghi)", "abc (def|ghi)"),
    ("abc(def|ghi)", "abc (bcd cde)|(bcg cgh) (def|ghi)"),
    ("a+hello", "ahe ell hel llo"),
    ("a*hello", "ell hel llo"),
    ("def|abc", "(abc|def)"),
    ("abc|def", "(abc|def)"),
    ("ab[cde]", "(abc|abd|abe)"),
    ("ab[cde]fgh", "fgh (abc bcf cfg)|(abd bdf dfg)|(abe bef efg)"),
    (".", "+"),
    ("(abc)+", "abc"),
    ("(abc)*", "+"),
    ("(abc)?", "+"),
    ("(abc){2}", "abc bca cab"),
    ("(abc){2,}", "abc bca cab"),
    ("(abc){1,3}", "abc"),
    ("hello.*hello", "ell hel llo"),
    ("^abcd$", "abc bcd"),
    ("[a-z]+", "+"),
    (r"abc\z", "abc"),
    ("abc?def", "def (abc bcd cde)|(abd bde)"),
    ("(foo|bar)baz", "baz (oba oob)|(arb rba) (bar|foo)"),
    ("x(abc|abd)y", "xab (abc|abd) (bcy|bdy)"),
    (r"\bfoobar\b", "bar foo oba oob"),
    ("fo+bar", "bar oba"),
    ("[a-zA-Z]bcdef", "bcd cde def"),
    ("pthread_mutex_t", "_mu ad_ d_m ead ex_ hre mut pth rea tex thr ute x_t"),
]

#: Expression, text, matching lines.
HITS = [
    ("x*", "abc\n", 1), ("$", "abc\n", 1), ("^$", "abc\n", 0), ("^$", "a\n\nb\n", 1), ("^", "a\nb\n", 2), ("x*", "", 0), ("$", "", 0),
    ("x*", "abc", 1), ("$", "abc", 1), ("c$", "abc", 1), ("^$", "a\n", 0), ("foo$", "foo\r\nbar\r\n", 1), ("^bar$", "foo\r\nbar\r\n", 1),
    ("^$", "a\r\n\r\nb\r\n", 1), ("^$", "a\r\nb\r\n", 0), ("a", "aaa\naa\nb\n", 2),
]
