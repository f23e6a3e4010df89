"""Column expressions: scalar maths and window functions over keyed series."""
