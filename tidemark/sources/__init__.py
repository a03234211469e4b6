"""Tables read from files, and the collections derived from them."""
