"""Value semantics and the library of composite expressions."""
