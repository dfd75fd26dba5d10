"""The three jobs end to end: collect answers, analyse routers, route new questions."""
