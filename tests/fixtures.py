"""Small code models, made by hand."""

from codeloom.catalog import Catalog
from codeloom.schema import SCHEMAS


def catalog(spark, **tables):
    out = {}
    for name, rows in tables.items():
        name = name.rstrip("_")
        s = SCHEMAS[name]
        out[name] = spark.createDataFrame([tuple(r.get(f.name) for f in s) for r in rows], s)
    return Catalog(spark, out)


def fn(i, name, module, start, end, **more):
    return {"id": i, "name": name, "module_id": module, "line_number_start": start, "line_number_end": end, **more}


def edges(*pairs):
    return [{"caller_id": a, "callee_id": b} for a, b in pairs]


def operators(spark):
    u, db = "test/module/user.hs", "test/module/user_db.hs"
    rows = [
        ("getUser", "UserId -> User", 10, 12, u, ["UserId"]), ("getAllUsers", "[User]", 15, 17, u, []), ("createUser", "UserData -> User", 20, 25, u, ["UserData"]),
        ("updateUser", "UserId -> UserData -> Maybe User", 30, 40, u, ["UserId", "UserData"]), ("deleteUser", "UserId -> Bool", 45, 55, u, ["UserId"]), ("findUserById", "UserId -> Maybe User", 10, 12, db, ["UserId"]),
        ("findAllUsers", "[User]", 15, 17, db, []), ("validateAndSave", "User -> UserData -> User", 20, 25, db, ["User", "UserData"]), ("removeUser", "UserId -> Bool", 30, 32, db, ["UserId"]), (None, "() -> ()", 1, 1, "test/module/empty.hs", []),
    ]
    f = [fn(i + 1, n, 1, a, z, function_signature=s, src_loc=f"{p}:{a}", function_input=inp, raw_string=f"{n} = body {i}" if n else "") for i, (n, s, a, z, p, inp) in enumerate(rows)]
    t = [{"id": i, "type_name": n, "line_number_start": a, "line_number_end": z, "type_of_type": k, "module_id": 1, "src_loc": u} for i, n, a, z, k in ((1, "User", 5, 10, "data"), (2, "UserId", 12, 13, "type"), (3, "UserData", 15, 20, "data"))]
    return catalog(spark, module=[{"id": 1, "name": "test.module", "path": "test/module"}], function=f, function_dependency=edges((4, 6), (5, 6), (5, 9), (1, 6), (2, 7), (3, 8), (4, 8)), type=t)


def service(spark):
    m = [{"id": i + 1, "name": n} for i, n in enumerate(("app.core", "app.util", "app.handlers"))]
    f = [
        fn(1, "processData", 1, 10, 15, raw_string="processData d = transform d"), fn(2, "validateInput", 2, 25, 30, raw_string="validateInput i = i"), fn(3, "requestHandler", 3, 40, 50, raw_string="requestHandler r = case validateInput r of\n  Just x -> processData x\n  Nothing -> errorResponse"),
        fn(4, "utilityFunction", 2, 5, 7, raw_string="utilityFunction = id"), fn(5, "dataHandler", 3, 20, 30, raw_string="dataHandler = processData"),
    ]
    t = [{"id": 1, "type_name": "Data", "module_id": 1, "line_number_start": 5, "line_number_end": 8}, {"id": 2, "type_name": "Response", "module_id": 3, "line_number_start": 10, "line_number_end": 13}]
    i = [{"id": k + 1, "module_name": n, "module_id": 3, "line_number_start": k + 1, "line_number_end": k + 1} for k, n in enumerate(("app.core", "app.util"))]
    return catalog(spark, module=m, function=f, where_function=[{"id": 1, "name": "errorResponse", "parent_function_id": 3}], function_dependency=edges((3, 2), (3, 1), (5, 1)), type=t, import_=i, class_=[{"id": 1, "class_name": "Processable", "module_id": 1, "line_number_start": 15, "line_number_end": 18}])


def mvc(spark):
    m = [{"id": i + 1, "name": f"app.{n}"} for i, n in enumerate(("controllers", "models", "views", "utils"))]
    names = {1: ("UserController", "ProductController", "AdminController"), 2: ("getUserModel", "getProductModel", "getAllUsers"), 3: ("renderUserView", "renderProductView", "renderAdminView", "renderErrorView"), 4: ("loadTemplate", "renderTemplate", "isValid", "isAdmin", "validateUser", "validateProduct")}
    f, i = [], 0
    for k, v in names.items():
        for n in v:
            i += 1
            raw = f"{n} x = case isValid x of\n  True -> ok\n  False -> err" if n.startswith("validate") else f"{n} = do\n  user <- load\n  render user"
            f.append(fn(i, n, k, 10, 20, raw_string=raw, function_signature="User -> Bool" if "alid" in n else "Request -> Response"))
    e = [(1, 4), (1, 7), (1, 10), (1, 13), (2, 5), (2, 8), (2, 10), (2, 13), (3, 6), (3, 9), (3, 10), (3, 14), (4, 15), (5, 16), (6, 15), (15, 13), (16, 13)] + [(v, t) for v in (7, 8, 9, 10) for t in (11, 12)]
    w = [{"id": 1, "name": "handleError", "parent_function_id": 1}, {"id": 2, "name": "handleError", "parent_function_id": 2}]
    return catalog(spark, module=m, function=f, where_function=w, function_dependency=edges(*e))
